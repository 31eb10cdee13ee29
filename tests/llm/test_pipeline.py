"""The corpus pipeline: each stage on awkward tables, and the whole against its stages' rules composed."""

import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import sentence
from tests.llm.test_dedup import like_lines, shingles, smallest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines long, row string, c0 int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of every kind; labels call those with many symbols poor."""
    rng = random.Random(21)
    good = [" ".join(sentence(rng, rng.randrange(15, 40)) for _ in range(3)) + "\n" + sentence(rng, 30) for _ in range(60)]
    texts = good + [good[0], good[0], good[1] + " tail", "short", "", None, "word " * 200, "\n".join([good[2], good[2], good[3]])]
    texts += [" ".join(w + "#" for w in sentence(rng, 80).split()) for _ in range(40)]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], len(t or ""), "k", i, "r", 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, good[7], "en", "s1", 1, "k", 1, "r", 7)]
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    poor = [(i, 0 if t and "#" in t else 1) for i, t in enumerate(texts) if t]
    spark.createDataFrame(poor, "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage gives, by name, its input first."""
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{root}/{name.replace(' ', '-')}"
        stage(spark, docs, root).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    for name in ("quality rules", "line dedup", "near dedup", "mix sources"):
        assert stages[name].columns == stages["input"].columns and stages[name].count() > 0


def test_quality_stage(stages, folder):
    """Documents of fewer than 50 words, of repeats and of symbols go; the others stay as they are."""
    _, rows = folder

    def fine(text):
        w = WORD.findall(text or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and "#" not in text

    assert Counter(rows_of(stages["quality rules"])) == Counter(r for r in rows if fine(r[1]))


def test_line_stage(stages):
    before = rows_of(stages["quality rules"])
    gone = like_lines({(r[0], r[1]) for r in before})
    want = []
    for r in before:
        text = r[1] if r[0] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if (r[0], n) not in gone)
        if WORD.search(text):
            want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    assert Counter(rows_of(stages["line dedup"])) == Counter(want)


def test_near_stage(stages):
    before = rows_of(stages["line dedup"])
    sets = {r[0]: shingles(r[1]) for r in before if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = smallest(ids, links)
    assert Counter(rows_of(stages["near dedup"])) == Counter(r for r in before if r[0] is None or group[r[0]] == r[0])


def test_mix_stage(stages):
    before, after = Counter(rows_of(stages["near dedup"])), Counter(rows_of(stages["mix sources"]))
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    words = lambda c: sum(n * len(WORD.findall(r[1])) for r, n in c.items())
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.15)


def test_packing_stage(stages):
    got = rows_of(stages["packing"].select("doc_id", "piece"))
    assert Counter(i for i, piece in got if piece == 0) == Counter(r[0] for r in rows_of(stages["mix sources"]))


def test_empty_table(spark, folder):
    root, _ = folder
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        assert out.collect() == [], name
        if name != "packing":
            docs = spark.createDataFrame([], SCHEMA)


def test_run_is_the_stages(spark, folder, stages):
    root, _ = folder
    assert sorted(map(str, rows_of(corpus_pipeline.run(spark, root).drop("sequence_id", "offset")))) == sorted(map(str, rows_of(stages["packing"].drop("sequence_id", "offset"))))
