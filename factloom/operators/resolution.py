"""Probabilistic record linkage: blocking keys, agreement levels, expectation-maximisation, constrained clusters.

Records are ``(rid, source, entity_type, name, tokens, postal, city, country, ids, given, family, birth)``; name and tokens are
normal forms, ``ids`` an array of ``struct(namespace, value)``. Missing fields are NULL. Pairs only come from shared keys; a block
above the model's own limit makes no pairs and is reported.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.functions.text import jaro_winkler, soundex
from factloom.operators.components import connected_components
from factloom.operators.identity import blocked_pairs, tfidf_similarity
from factloom.operators.staging import Staging

EPSILON = 1e-9
#: Comparisons of each kind with their number of levels.
LEVELS = {
    "organization": {"name": 4, "tfidf": 3, "postal": 3, "city": 2, "country": 2, "identifier": 2},
    "person": {"name": 4, "family": 3, "given": 3, "birth": 2, "postal": 3, "identifier": 2},
}
FIELDS = {"source": "string", "entity_type": "string", "name": "string", "tokens": "array<string>", "postal": "string", "city": "string", "country": "string", "ids": "array<struct<namespace:string,value:string>>", "given": "string", "family": "string", "birth": "string"}


def prepared(records: DataFrame) -> DataFrame:
    """The records with all fields, blank texts as NULL, identifiers trimmed and in capitals under lower-case namespaces."""
    cols = {}
    for c, kind in FIELDS.items():
        value = F.col(c) if c in records.columns else F.lit(None)
        cols[c] = F.nullif(F.trim(value.cast("string")), F.lit("")) if kind == "string" else value.cast(kind)
    out = records.select("rid", *[v.alias(c) for c, v in cols.items()])
    clean = F.transform("ids", lambda i: F.struct(F.lower(F.trim(i["namespace"])).alias("namespace"), F.upper(F.trim(i["value"])).alias("value")))
    return out.withColumn("ids", F.array_distinct(F.filter(F.coalesce(clean, F.array().cast(FIELDS["ids"])), lambda i: i["value"].isNotNull() & (i["value"] != ""))))


def blocking_keys(records: DataFrame, kind: str = "organization") -> DataFrame:
    """``(rid, key)``: a name's beginning and first word by place, its sounds, its first two words, and every identifier."""
    place = F.coalesce(F.substring("postal", 1, 3), F.col("country"), F.lit(""))
    tokens, compact = F.coalesce("tokens", F.array().cast("array<string>")), F.replace(F.coalesce("name", F.lit("")), F.lit(" "), F.lit(""))
    sounds = F.array_join(F.transform(F.slice(tokens, 1, 2), soundex), "")
    keys = [
        F.when(compact != "", F.concat(F.lit("p:"), F.substring(compact, 1, 6), F.lit("|"), place)),
        F.when(F.size(tokens) > 0, F.concat(F.lit("f:"), F.get(tokens, F.lit(0)), F.lit("|"), place)),
        F.when(F.size(tokens) > 0, F.concat(F.lit("s:"), sounds, F.lit("|"), F.coalesce("country", F.lit("")))),
        F.when(F.size(tokens) > 1, F.concat(F.lit("k:"), F.array_join(F.slice(F.array_sort(tokens), 1, 2), " "))),
    ]
    if kind == "person":
        keys.append(F.when(F.col("family").isNotNull(), F.concat(F.lit("n:"), soundex(F.col("family")), F.lit("|"), F.coalesce(F.substring("given", 1, 1), F.lit("")))))
    ids = F.transform("ids", lambda i: F.concat(F.lit("i:"), i["namespace"], F.lit(":"), i["value"]))
    return records.select("rid", F.explode(F.array_distinct(F.filter(F.concat(F.array(*keys), ids), lambda k: k.isNotNull()))).alias("key"))


def candidate_pairs(records: DataFrame, keys: DataFrame, max_block: int, across_sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` that share a key, and ``(key, n)`` of the blocks left out as larger than ``max_block``."""
    large = keys.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_block)
    return blocked_pairs(records, keys, max_block, across_sources), large


def _both(pairs: DataFrame, records: DataFrame) -> DataFrame:
    columns = [c for c in records.columns if c != "rid"]
    side = lambda s: records.select(F.col("rid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _equal(c: str) -> Column:
    a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1).otherwise(0))


def identifier_level(unique: list[str]) -> Column:
    """1 if any identifier is shared, 0 if a unique namespace contradicts, NULL otherwise."""
    a, b = F.col("ids_a"), F.col("ids_b")
    mine = lambda ids, ns: F.filter(ids, lambda i: i["namespace"] == F.lit(ns))
    clash = F.lit(False)
    for ns in unique:
        clash = clash | ((F.size(mine(a, ns)) > 0) & (F.size(mine(b, ns)) > 0) & ~F.arrays_overlap(mine(a, ns), mine(b, ns)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(F.arrays_overlap(a, b), 1).when(clash, 0))


def compare(pairs: DataFrame, records: DataFrame, kind: str = "organization", unique: list[str] | None = None) -> DataFrame:
    """``(a, b, *levels, pattern)``; a missing side gives a NULL level, ``_`` in the pattern."""
    both = _both(pairs, records)
    jw = jaro_winkler("name_a", "name_b")
    name = F.when(F.col("name_a") == F.col("name_b"), 3).when(F.col("_jw") >= 0.95, 2).when(F.col("_jw") >= 0.85, 1).when(F.col("_jw").isNotNull(), 0)
    postal = F.when(F.col("postal_a").isNotNull() & F.col("postal_b").isNotNull(), F.when(F.col("postal_a") == F.col("postal_b"), 2).when(F.substring("postal_a", 1, 3) == F.substring("postal_b", 1, 3), 1).otherwise(0))
    both = both.withColumn("_jw", jw)
    levels = {"name": name, "postal": postal, "identifier": identifier_level(unique or [])}
    if kind == "person":
        both = both.withColumn("_jf", jaro_winkler("family_a", "family_b"))
        levels["family"] = F.when(F.col("family_a") == F.col("family_b"), 2).when(F.col("_jf") >= 0.92, 1).when(F.col("_jf").isNotNull(), 0)
        levels["given"] = F.when(F.col("given_a").isNotNull() & F.col("given_b").isNotNull(), F.when(F.col("given_a") == F.col("given_b"), 2).when(F.substring("given_a", 1, 1) == F.substring("given_b", 1, 1), 1).otherwise(0))
        levels["birth"] = _equal("birth")
    else:
        cosine = tfidf_similarity(records.select("rid", F.explode("tokens").alias("token")), pairs)
        both = both.join(cosine, ["a", "b"], "left")
        levels["tfidf"] = F.when(F.col("cosine") >= 0.85, 2).when(F.col("cosine") >= 0.5, 1).when(F.col("cosine").isNotNull(), 0)
        levels |= {"city": _equal("city"), "country": _equal("country")}
    names = list(LEVELS[kind])
    out = both.select("a", "b", *[levels[n].cast("int").alias(n) for n in names])
    return out.withColumn("pattern", F.concat(*[F.coalesce(F.col(n).cast("string"), F.lit("_")) for n in names]))


class FellegiSunter:
    """Match and non-match probabilities of each level, estimated from the counts of patterns.

    The patterns number at most the product of the levels; only their counts reach the driver.
    """

    def __init__(self, levels: dict[str, int], prior: float = 0.05):
        self.names, self.sizes, self.prior = list(levels), list(levels.values()), prior
        rising = [[i + 1 for i in range(n)] for n in self.sizes]
        self.m = [[v**3 / sum(x**3 for x in row) for v in row] for row in rising]
        self.u = [list(reversed(row)) for row in self.m]
        self.rounds, self.converged, self.fixed = 0, False, ""

    def decode(self, pattern: str) -> list[int | None]:
        return [None if c == "_" else int(c) for c in pattern]

    def _likelihoods(self, pattern: str) -> tuple[float, float]:
        pm = pu = 1.0
        for k, level in enumerate(self.decode(pattern)):
            if level is not None:
                pm, pu = pm * self.m[k][level], pu * self.u[k][level]
        return pm, pu

    def fit(self, counts: dict[str, int], rounds: int = 500, tolerance: float = 1e-7) -> FellegiSunter:
        """Expectation-maximisation; what ``fix`` has set stays. If the classes come out swapped they are turned round."""
        total = sum(counts.values())
        if not total:
            raise ValueError("no comparison patterns")
        for self.rounds in range(1, rounds + 1):
            m, u = ([[EPSILON] * n for n in self.sizes] for _ in range(2))
            matched = 0.0
            for pattern, count in sorted(counts.items()):
                pm, pu = self._likelihoods(pattern)
                top, both = self.prior * pm, self.prior * pm + (1 - self.prior) * pu
                g = top / both if both > 0 else 0.0
                matched += count * g
                for k, level in enumerate(self.decode(pattern)):
                    if level is not None:
                        m[k][level] += count * g
                        u[k][level] += count * (1 - g)
            shares = lambda table: [[v / sum(row) for v in row] for row in table]
            new = (min(max(matched / total, EPSILON), 1 - EPSILON), self.m if "m" in self.fixed else shares(m), self.u if "u" in self.fixed else shares(u))
            moved = max(abs(new[0] - self.prior), *(abs(x - y) for old, now in ((self.m, new[1]), (self.u, new[2])) for r, q in zip(old, now) for x, y in zip(r, q)))
            self.prior, self.m, self.u = new
            if moved < tolerance:
                self.converged = True
                break
        if not self.fixed and 2 * sum(a[-1] > b[-1] for a, b in zip(self.m, self.u)) < len(self.sizes):
            self.m, self.u, self.prior = self.u, self.m, 1 - self.prior
        return self

    def fix(self, which: str, counts: dict[str, float]) -> FellegiSunter:
        """Sets m or u from counts of patterns of known pairs (labelled matches, or random pairs)."""
        table = [[0.5] * n for n in self.sizes]
        for pattern, count in counts.items():
            for k, level in enumerate(self.decode(pattern)):
                if level is not None:
                    table[k][level] += count
        setattr(self, which, [[v / sum(row) for v in row] for row in table])
        self.fixed += which
        return self

    def weight(self, pattern: str) -> float:
        """Log2 odds that the levels give, the prior apart."""
        return sum(math.log2(max(self.m[k][v], EPSILON) / max(self.u[k][v], EPSILON)) for k, v in enumerate(self.decode(pattern)) if v is not None)

    def probability(self, pattern: str, prior: float | None = None) -> float:
        p = self.prior if prior is None else prior
        odds = self.weight(pattern) + math.log2(p / (1 - p))
        return 1.0 if odds > 60 else 0.0 if odds < -60 else 1 / (1 + 2**-odds)


def pattern_counts(compared: DataFrame) -> dict[str, int]:
    return {r["pattern"]: r["n"] for r in compared.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # bounded by the levels


def random_pairs(records: DataFrame, per_record: int = 1, seed: int = 0) -> DataFrame:
    """Pairs of records neighbouring in random orders, to estimate how often strangers agree."""
    out = None
    for i in range(per_record):
        shard = F.pmod(F.xxhash64(F.lit(seed + i), F.lit("shard"), "rid"), F.lit(64))
        ranked = records.select("rid", F.lead("rid").over(W.partitionBy(shard).orderBy(F.xxhash64(F.lit(seed + i), "rid"), "rid")).alias("other")).where("other is not null")
        pairs = ranked.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).where("a < b")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def score(compared: DataFrame, model: FellegiSunter) -> DataFrame:
    """``(a, b, pattern, weight, probability)`` by a join with one row a pattern."""
    patterns = sorted(pattern_counts(compared))
    rows = [(p, model.weight(p), model.probability(p)) for p in patterns]
    table = compared.sparkSession.createDataFrame(rows, "pattern string, weight double, probability double")
    return compared.select("a", "b", "pattern").join(F.broadcast(table), "pattern").select("a", "b", "pattern", "weight", "probability")  # one row a pattern


def cluster(scored: DataFrame, records: DataFrame, staging: Staging, threshold: float = 0.95, lower: float = 0.5, max_size: int = 50, unique: list[str] | None = None, reviews: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rid, cluster)`` and the links ``(a, b, probability, outcome)``, outcome ``used`` or why a link was refused.

    Links join clusters in falling probability, ties by ids, forced ones (accepted ``reviews``) first. A join is refused if the cluster
    would be too large, hold a pair a review rejects, contradict a unique identifier or the entity type, or hold a pair scored
    below ``lower``. Which joins happen depends on the order, but only within a connected component of the links, so components are
    worked on side by side; each is one group.
    """
    unique = unique or []
    links = scored.where(F.col("probability") >= threshold).select("a", "b", "probability", F.lit(1).alias("kind"))
    no = scored.where(F.col("probability") < lower).select("a", "b", "probability", F.lit(-1).alias("kind"))
    if reviews is not None:
        links = links.unionByName(reviews.where("accepted").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(2.0).alias("probability"), F.lit(2).alias("kind")))
        no = no.unionByName(reviews.where("not accepted").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(-1.0).alias("probability"), F.lit(-2).alias("kind")))
    links = staging.write(links, "links")
    comps = staging.write(connected_components(links, staging), "link-components")
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    kept = links.unionByName(no).join(of("a"), "a").join(of("b"), "b").where("c_a = c_b").select(F.col("c_a").alias("component"), "a", "b", "probability", "kind")
    facts = records.select("rid", "entity_type", F.filter("ids", lambda i: i["namespace"].isin(unique) if unique else F.lit(False)).alias("ids")).join(comps.withColumnRenamed("node", "rid"), "rid")
    kind = dict(records.dtypes)["rid"]

    def run(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        group = {r: {r} for r in members["rid"]}
        types = {r: {t} - {None} for r, t in zip(members["rid"], members["entity_type"])}
        ids: dict = {}
        for r, found in zip(members["rid"], members["ids"]):
            ids[r] = {}
            for i in found if found is not None else ():
                ids[r].setdefault(i["namespace"], set()).add(i["value"])
        home = {r: r for r in group}
        against: dict = {}
        for a, b, k in zip(pairs["a"], pairs["b"], pairs["kind"]):
            if k < 0:
                against.setdefault(a, []).append((b, k))
                against.setdefault(b, []).append((a, k))
        out = []
        for a, b, p, k in sorted((t for t in zip(pairs["a"], pairs["b"], pairs["probability"], pairs["kind"]) if t[3] > 0), key=lambda t: (-t[2], t[0], t[1])):
            x, y = home[a], home[b]
            if x == y:
                continue
            small, large = (x, y) if len(group[x]) <= len(group[y]) else (y, x)
            barred = {kind for r in group[small] for other, kind in against.get(r, ()) if home.get(other) == large}
            apart = any(ns in ids[y] and (not v & ids[y][ns] or len(v | ids[y][ns]) > 1) for ns, v in ids[x].items())
            if len(group[x]) + len(group[y]) > max_size:
                outcome = "max_cluster_size"
            elif -2 in barred:
                outcome = "rejected_review"
            elif apart:
                outcome = "identifier_conflict"
            elif types[x] and types[y] and types[x] != types[y]:
                outcome = "entity_type_conflict"
            elif -1 in barred and k == 1:
                outcome = "transitivity_conflict"
            else:
                outcome = "used"
                for r in group[small]:
                    home[r] = large
                group[large] |= group.pop(small)
                types[large] |= types.pop(small)
                for ns, v in ids.pop(small).items():
                    ids[large].setdefault(ns, set()).update(v)
            out.append((a, b, min(1.0, p), outcome))
        rows = [(r, min(g), None, None, None, None) for g in group.values() for r in g]
        return pd.DataFrame(rows + [(None, None, *o) for o in out], columns=["rid", "cluster", "a", "b", "probability", "outcome"]).astype(object)

    worked = kept.groupBy("component").cogroup(facts.groupBy("component")).applyInPandas(run, f"rid {kind}, cluster {kind}, a {kind}, b {kind}, probability double, outcome string")
    worked = staging.write(worked, "clusters")
    placed = worked.where("rid is not null").select("rid", "cluster")
    alone = records.select("rid").join(placed.select("rid"), "rid", "left_anti").select("rid", F.col("rid").alias("cluster"))
    return placed.unionByName(alone), worked.where("outcome is not null").select("a", "b", "probability", "outcome")


def match_assertions(links: DataFrame, observed_at: str) -> DataFrame:
    """Used links as ``same_as`` assertions with their probability."""
    used = links.where("outcome = 'used'")
    return used.select(F.concat_ws(":", F.lit("match"), "a", "b").alias("id"), F.lit("assertion").alias("kind"), F.col("a").cast("string").alias("subject"), F.lit("same_as").alias("predicate"), F.col("b").cast("string").alias("object"), "probability", F.lit(observed_at).cast("timestamp_ntz").alias("observed_at"))


def resolved_view(clusters: DataFrame) -> DataFrame:
    """``(entity, canonical)`` of entities in clusters of two or more; the smallest id stands for a cluster."""
    n = F.count("*").over(W.partitionBy("cluster"))
    return clusters.withColumn("_n", n).where("_n > 1").select(F.col("rid").alias("entity"), F.min("rid").over(W.partitionBy("cluster")).alias("canonical"))


def members_of(clusters: DataFrame) -> DataFrame:
    """``(cluster, size, members)``, members in order."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("rid")).alias("members"))


def violations(scored: DataFrame, clusters: DataFrame, lower: float = 0.5) -> DataFrame:
    """Pairs within one cluster that the model scores below ``lower``."""
    of = lambda side: clusters.select(F.col("rid").alias(side), F.col("cluster").alias(f"c_{side}"))
    return scored.where(F.col("probability") < lower).join(of("a"), "a").join(of("b"), "b").where("c_a = c_b").select(F.col("c_a").alias("cluster"), "a", "b", "probability")


def inputs_from_records(records: DataFrame) -> DataFrame:
    """Linkage records from evidence entities ``(rid, dataset, label, attributes map, identifiers)``."""
    from factloom.functions.text import organization, tokens, transliterate

    name = organization(transliterate(F.col("label")))
    attribute = lambda k: F.try_element_at("attributes", F.lit(k))
    return records.select("rid", F.col("dataset").alias("source"), attribute("entity_type").alias("entity_type"), name.alias("name"), tokens(name).alias("tokens"), F.substring(attribute("postal_code"), 1, 5).alias("postal"), F.lower(attribute("city")).alias("city"), F.upper(attribute("country")).alias("country"), F.col("identifiers").alias("ids"))


def similar_entities(records: DataFrame, text: Column | str, threshold: float = 0.85) -> DataFrame:
    """Records whose name is like a query's, best first: exact names before near ones."""
    q = F.lit(text) if isinstance(text, str) else text
    scored = records.where("name is not null").withColumn("similarity", F.when(F.col("name") == q, 1.0).otherwise(jaro_winkler(F.col("name"), q)))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "rid")
