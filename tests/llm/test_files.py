"""Packing, media and token files against the tokenizer and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import media, packing, tokens
from factloom.operators.staging import Staging

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "0", "a0b 0 00", "it's 'S we'LL x's.'t", "İstanbul ẞ ΑΣ ς é ́x nb z", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>x<|endoftext|><|endoftext|>'s <|endoftext| >", "汉字 漢 0字 ½ ² ٠ 1２3", "tab\tnew\nline\x0b\x0c\r\x1c\x85 q", "Ünïcode ÉTÉ straße ª º µm ÿ Œuvre..,!"]


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_cache_is_exact(encode, corpus, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    w = tokens.WordTokenizer(PATH)
    for text in [*ODD, *(r[1] for r in corpus), *ODD]:
        assert w.encode(text).tolist() == encode(text), text


def test_token_files(spark, docs, corpus, encode):
    st = Staging(spark, "test")
    folder = st.folder("ids")
    index = tokens.write_ids(docs, folder, PATH, 2, st)
    got = tokens.read_ids(docs, folder, index).collect()
    want, at = [], 0
    for r in sorted(corpus, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*encode(r[1]), 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert index["dtype"] == "<u2" and sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_empty(spark, empty):
    st = Staging(spark, "test")
    folder = st.folder("ids")
    assert tokens.read_ids(empty, folder, tokens.write_ids(empty, folder, PATH, 2, st)).collect() == []


def test_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 200))]
        bins = packing.best_fit(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        free: list[int] = []
        for s in sorted(sizes, reverse=True):  # plain best fit
            fit = [f for f in free if f >= s]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - s)
            else:
                free.append(100 - s)
        assert len(bins) == len(free)


@pytest.mark.parametrize(("room", "fan"), [(4096, 8), (100, 2)])
def test_packing(docs, corpus, encode, room, fan):
    got = packing.pack(docs, PATH, room=room, fan=fan).collect()
    want = []
    for r in corpus:
        ids = [*encode(r[1]), 1]
        want += [(r[0], at // room, at, len(ids[at : at + room]), zlib.crc32(np.array(ids[at : at + room], "<u4").tobytes())) for at in range(0, len(ids), room)]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= room
    assert len(sequences) <= 1.1 * sum(w[3] for w in want) / room + 2


def test_packing_of_large_documents_doesnt_gather(spark, monkeypatch):
    """No two of these share a sequence: a round without merges ends the tree, whatever the number of partitions."""
    rows = [(i, "a " * 60) for i in range(200)]
    seen = []
    merger = packing._merger
    monkeypatch.setattr(packing, "_merger", lambda level, *rest: seen.append(level) or merger(level, *rest))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(64), PATH, room=100, fan=2).collect()
    assert len({r["sequence_id"] for r in got}) == 200 and all(r["offset"] == 0 for r in got) and seen == [1]


def test_packing_empty(empty):
    assert packing.pack(empty, PATH).collect() == []


def test_media_round_trip(docs, corpus):
    got = media.media_columns(docs).collect()
    assert len(got) == len(corpus)
    texts = {r[0]: r[1] for r in corpus}
    same: dict = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        rest = (r["media_bytes"], r["media_sha256"], r["feature"], r["n_chunks"])
        assert same.setdefault(payload, rest) == rest


def test_named_store_is_read_without_the_run(spark, docs):
    got = {r["payload_sha256"]: r["media_sha256"] for r in media.media_columns(docs, store="kept_media").collect()}
    again = {bytes(r["media"]).hex(): bytes(r["form"]).hex() for r in media.restored(spark, "kept_media").collect()}
    assert again == got and not [t for t in spark.catalog.listTables() if t.name.startswith("chunk_store_")]
    for t in ("kept_media", "kept_media_recipes", "kept_media_dictionary"):
        spark.sql(f"DROP TABLE {t}")


def test_media_empty(empty):
    assert media.media_columns(empty).collect() == []


def test_chunks_follow_content():
    rng = random.Random(9)
    gear = media._gear()
    a = bytes(rng.randrange(97, 123) for _ in range(300_000))
    chunks = media.chunks_of(a, gear)
    assert b"".join(chunks) == a and all(len(c) <= media.MOST for c in chunks) and all(len(c) >= media.LEAST for c in chunks[:-1])
    shifted = media.chunks_of(b"xyz" + a, gear)
    assert len(set(chunks) & set(shifted)) >= 0.8 * len(chunks)


def test_damaged_chunk_is_found(spark):
    rows = [(b"m" * 32, [(0, b"d" * 32, b"not compressed")])]
    gathered = spark.createDataFrame(rows, "media binary, chunks array<struct<place:int,digest:binary,data:binary>>")
    with pytest.raises(Exception, match="zstd|frame|decompress"):
        media.read_back(gathered, b"").collect()
