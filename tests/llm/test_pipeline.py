"""The pipeline's stages, and the registered queries."""

from __future__ import annotations

import itertools
import os
import random
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from ruleloom.llm import mixing, near_copies, pii, sp_sampling, toxicity
from ruleloom.llm.common import materialize
from ruleloom.llm.components import connected_components
from ruleloom.llm.queries import OP9_SQL, oracle_sql, pseudonym_key, queries
from tests.llm.conftest import ODD_TEXTS

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "private_data", "mixing", "pieces"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns and after.schema == docs.schema
        if name == "toxicity":
            assert 0.5 * docs.count() < after.count() <= docs.count()
        if name == "near_duplicates":
            assert after.count() < now.count()
        if name == "mixing":
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in now.select("doc_id").collect()}
        now = spark.createDataFrame(after.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert out.count() == now.count() and out.where("not lossless").count() == 0


def test_stages_take_odd_and_empty_tables(spark, odd, nothing, extra):
    for docs in (extra(odd), nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == ["doc_id", "text", "lang", "source", "n_chars"]
            stage(spark, docs, SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, None if t is None else len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def prose(seed, n=40):
    r = random.Random(seed)
    return " ".join(f"word{r.randrange(10**6)}" for _ in range(n))


def test_only_copies_go(spark, odd):
    rows = [(None, prose(1), "a"), (None, prose(2), "a"), (7, prose(3), "a"), (7, prose(4), "b"), (9, prose(1) + " more", "a"), (8, prose(1), "a"), (8, prose(1), "a"), (None, prose(5), None), (None, prose(5), None)]
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SF).collect()
    assert Counter((x.doc_id, x.text) for x in kept) == Counter([(None, prose(2)), (7, prose(3)), (7, prose(4)), (8, prose(1)), (None, prose(5))])
    texts = Counter(x.text for x in corpus_pipeline.drop_near_copies(spark, odd, SF).collect())
    assert texts[ODD_TEXTS[0][1]] + texts[ODD_TEXTS[9][1]] == 1 and texts["a row without a key"] == 1 and texts["one"] == 1
    assert texts[None] + texts[""] + texts[ODD_TEXTS[4][1]] == 1


def test_the_mix_takes_every_row_on_its_own(spark):
    rows = [(1, prose(1), "a"), (1, prose(2), "b"), (None, prose(3), "a"), (None, prose(4), "c"), (None, None, "c"), (1, prose(2), "b")]
    docs = documents(spark, rows)
    copies = Counter({(x.doc_id, x.source, x.text): 0 for x in docs.collect()})
    plan = mixing.mix(docs).collect()
    out = Counter((x.doc_id, x.source, x.text) for x in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert set(out) <= set(copies) and sum(out.values()) == sum(x.copies for x in plan)
    assert all(out[r] <= 2 * sum((k, s, t) == r for k, t, s in rows) for r in out)


def test_pipeline_against_brute_force(spark):
    """Every stage's rows, computed again in plain Python from the rows of the one before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, before):
        return Counter(map(tuple, stages[name](spark, before, SF).collect()))

    again = lambda rows: spark.createDataFrame([r for r, n in rows.items() for _ in range(n)], docs.schema)
    # toxicity: labels outside fold 0, scores of whole texts
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    fit = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id in toxic)
    model = toxicity.fit_model([t for _, t in fit], [toxic[k] for k, _ in fit])
    one = run("toxicity", docs)
    assert one == Counter(tuple(r) for r in docs.collect() if model.score(r.text) < 0.5)
    # near duplicates: all pairs of shingle sets
    docs = again(one)
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if root[a] != root[b] and (x == y or len(x & y) >= 0.8 * len(x | y)):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    two = run("near_duplicates", docs)
    assert two == Counter(tuple(r) for r in docs.collect() if root[r.doc_id] == r.doc_id)
    # private data: the operator's texts (brute force of these in test_operators), lengths anew
    docs = again(two)
    texts = {r.doc_id: r.text for r in pii.pseudonymize(docs, pseudonym_key(spark)).collect()}
    three = run("private_data", docs)
    assert three == Counter((r.doc_id, texts[r.doc_id], r.lang, r.source, None if texts[r.doc_id] is None else len(texts[r.doc_id])) for r in docs.collect())
    # mixing: the SQL of the operator
    docs = again(three)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    taken = {k: (size, n) for k, size, _, _, n in con.execute(OP9_SQL).fetchall()}
    four = run("mixing", docs)
    for r in docs.collect():
        size, n = taken[r.doc_id]
        assert size == 0 or four[tuple(r)] * size == n
    # pieces: each row by itself
    docs = again(four)
    s = sp_sampling.sampler(sp_sampling.default_model(), 1.0)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for x in stages["pieces"](spark, docs, SF).collect():
        ids, _ = s.sample([str(x.doc_id)], [rows[x.doc_id]])
        assert x.ids == ids.tolist() and x.lossless


def test_names():
    assert set(oracle_sql()) <= set(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_near_copies_at_four_fifths_go(spark):
    r = random.Random(5)
    rows = []
    for i in range(0, 120, 2):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice((30, 80, 300)))]
        copy = list(words)
        for _ in range(max(1, len(words) // 50)):
            copy[r.randrange(len(words))] = "other"
        rows += [(i, " ".join(words)), (i + 1, " ".join(copy))]
    rows += [(200 + i, " ".join([f"x{j}" for j in range(60)] + [f"own{i}"])) for i in range(40)]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert kept == sorted(set(root.values())) and 60 < len(kept) < 120
    prints = near_copies.shingled(docs).cache()
    nodes = prints.select("node", F.col("k").alias("rep"), "bands")
    for chunk in (7, 1024):
        parts = connected_components(near_copies.near_links(prints, nodes, chunk=chunk))
        grouped = nodes.join(parts, "node").groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")).collect()
        assert sorted((x.least, x.n) for x in grouped) == sorted((k, n) for k, n in Counter(root.values()).items() if n > 1)


def test_near_copies_are_found_by_simhash_and_held_to_their_sets(spark):
    words = prose(6, 400).split()
    copy = [*words[:200], "other", *words[201:]]
    rows = [(1, " ".join(words), "a"), (2, " ".join(copy), "a"), (3, prose(7), "a"), (4, prose(8), "a"), (5, "", "a"), (6, None, "a")]
    prints = near_copies.shingled(documents(spark, rows))
    prints = spark.createDataFrame(prints.collect(), prints.schema)
    node = {r.k: r.node for r in prints.collect()}
    # without a MinHash key the fingerprints alone lead to the pair
    bare = prints.select("node", F.col("k").alias("rep"), F.lit(None).cast("array<bigint>").alias("none")).select("node", "rep", F.coalesce("none", F.array().cast("array<bigint>")).alias("bands"))
    links = near_copies.near_links(prints, bare).collect()
    assert [{r.a, r.b} for r in links] == [{node[1], node[2]}]
    # equal fingerprints of unlike sets make no link
    same = prints.withColumn("fp", F.lit(7).cast("bigint"))
    assert [{r.a, r.b} for r in near_copies.near_links(same, bare).collect()] == [{node[1], node[2]}]
    of = {r.node: r.cell for r in near_copies.cells(prints).collect()}
    assert of[node[1]] == of[node[2]] and len(set(of.values())) == 3 and node[5] not in of


def test_near_copies_write_less_than_the_texts(spark, monkeypatch):
    r = random.Random(9)
    known = ["".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choices(known, k=500)), "a") for i in range(200)]
    written = []

    def counted(df, tag):
        out = materialize(df, tag)
        path = out._written_to.removeprefix("file:")
        written.append(sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)))
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    assert near_copies.near_copies(documents(spark, rows)).count() == 200
    assert 0 < sum(written) < sum(len(t) for _, t, _ in rows)
