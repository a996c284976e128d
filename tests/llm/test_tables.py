"""Operators on vectors and keys against brute force, and the pipeline stage by stage."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from tidemark.llm import block_knn, components, lattice_dedup, mixing, packing, queries, sharding, toxicity
from tidemark.plans.compare import differences, oracle_frame

VECTORS = "vec_id long, embedding array<float>, label int, rep string, cells int"


def vectors():
    source = np.random.default_rng(5)
    rows, at = [], 0
    for label in (1, 2, None):
        for _ in range(40):
            center = source.normal(size=16)
            for _ in range(source.integers(1, 6)):
                rows.append((at, (center + 0.04 * source.normal(size=16)).astype(np.float32).tolist(), label))
                at += 1
    dense = source.normal(size=16)
    for i in range(120):
        rows.append((at + i, (dense + 0.05 * source.normal(size=16)).astype(np.float32).tolist(), 3))
    at += 120
    rows += [(at + i, rows[0][1], 1) for i in range(30)]
    at += 30
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows += [(at + i, v, 1) for i, v in enumerate(bad)]
    rows += [(at + 10, [1.0, 2.0], 1), (at + 11, [2.0, 4.0], 1), (None, rows[0][1], 1), (5, rows[5][1], rows[5][2])]
    return rows


def fit(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in vectors()], VECTORS)


def test_lattice_dedup(table, monkeypatch):
    rows = vectors()
    got = lattice_dedup.near_duplicates(table).toPandas()
    links = collections.defaultdict(set)
    for i, (a, v, l) in enumerate(rows):
        for j, (b, w, m) in enumerate(rows[:i]):
            if l is not None and l == m and a is not None and b is not None and fit(v) and fit(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    want = []
    for i, (a, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want.append((-1 if a is None else a, len(links[i]), min(ids) if ids else -1))
    shown = sorted(zip(got.vec_id.fillna(-1).astype(int), got.n_links, got.component_id.fillna(-1).astype(int)))
    found, wanted = sum(x[1] for x in shown), sum(x[1] for x in want)
    assert 0.995 * wanted <= found <= wanted
    assert sum(a == b for a, b in zip(shown, sorted(want))) >= 0.98 * len(rows)
    assert (got.kept == (got.vec_id.fillna(-1) == got.component_id.fillna(-1))).all()


def test_small_tiles_count_each_pair_once(table, monkeypatch):
    whole = lattice_dedup.near_duplicates(table).groupBy().sum("n_links").first()[0]
    monkeypatch.setattr(lattice_dedup, "TILE", 16)
    assert lattice_dedup.near_duplicates(table).groupBy().sum("n_links").first()[0] == whole


def test_decoding_finds_the_nearest_point():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 3
    home = lattice_dedup.decoded(x)
    steps = lattice_dedup.shortest()
    assert len(steps) == 240
    assert (((x - home) ** 2).sum(1) <= ((x[:, None] - home[:, None] - steps) ** 2).sum(2).min(1) + 1e-12).all()


@pytest.mark.parametrize("tile", [7, 2048])
def test_nearest(table, monkeypatch, tile):
    monkeypatch.setattr(block_knn, "TILE", tile)
    monkeypatch.setattr(block_knn, "GROUP", 5)
    asked = table.where("vec_id % 20 = 0")
    got = block_knn.nearest(asked, table).toPandas()
    rows = sorted({(i, tuple(v)) for i, v, _ in vectors() if i is not None and fit(v)})
    for q, x in rows:
        if q % 20:
            continue
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(x))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(near) + 1))
        assert mine.vec_id.tolist() == [i for _, i in near]
        assert np.allclose(mine.score, [d for d, _ in near], rtol=1e-9)


def test_vectors_of_empty_tables(table):
    assert lattice_dedup.near_duplicates(table.limit(0)).count() == 0
    assert block_knn.nearest(table.limit(0), table.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (299, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{200 + i: 100 for i in range(50)}, 100: 100, 300: 299, 299: 299}


def test_sharding(spark):
    owner = sharding.lookup_table(sharding.SHARDS, sharding.SLOTS)
    sizes = collections.Counter(owner)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1], sharding.SLOTS)
    assert sum(a != b and a != 15 for a, b in zip(owner, fewer)) < 0.1 * sharding.SLOTS
    rows = spark.createDataFrame([(None, "a", 1), (5, "b", 2), (5, "c", 3)], "k long, slot string, shard int")
    placed = sharding.place(rows, "k")
    assert placed.columns == ["k", "slot", "shard"] and placed.count() == 3 and placed.select("k", "shard").distinct().count() == 2
    clashing = spark.createDataFrame([(1, "x", "y", "z")], "k long, __slot string, __owner string, __shard string")
    assert [tuple(r)[:4] for r in sharding.place(clashing, "k").collect()] == [(1, "x", "y", "z")]
    with pytest.raises(ValueError):
        sharding.lookup_table(("a", "a"), 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(("a", "b"), 8)


def test_mixing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    rows = [(i, "word " * (1 + i % 40), "en", "big" if i % 10 else ("small" if i % 20 else None), 1) for i in range(2000)] + [(3, "word", "en", "big", 1), (None, "a b", "en", "big", 1), (5000, None, "en", "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "documents.parquet")
    docs.coalesce(1).write.parquet(path)
    got = mixing.query(spark, str(tmp_path)).toPandas()
    import duckdb

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
        want = db.execute(mixing.ORACLE.replace(str(1 << 16), "500")).df()
    assert len(got) > len(rows) * 1.05 and differences(got, want) is None
    counts = got.groupby(["doc_id", "source"], dropna=False).size()
    assert (counts >= 1).all() and set(got.doc_id.dropna()) == {r[0] for r in rows if r[0] is not None}
    ordered = mixing.in_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == len(got)
    assert mixing.in_order(docs.limit(0)).count() == 0


def test_mixing_keeps_wordless_blocks_at_the_end_of_a_pass(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    rows = [(100 * s + i, "word " * 100 if i < 4 else "", f"src{s}") for s in range(20) for i in range(12)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert sorted(d["doc_id"] for d in got.doc) == [r[0] for r in rows] and got["place"].max() <= 1


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["s", "of", "budget", "upto", "src", "id", "tokens", "total", "passes", "repeats", "blocks", "pass", "block", "at", "size", "turn", "left", "order", "b", "p", "sum", "doc", "__order", "__pass", "__block", "__at", "__place", "__s", "__of"]
    rows = [(i, "word " * (1 + i % 7), "big" if i % 5 else "small", *(f"{n}{i}" for n in names)) for i in range(50)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *(f"`{n}` string" for n in names)]))
    ordered = mixing.in_order(docs)
    assert ordered.schema == docs.schema and {tuple(r) for r in ordered.collect()} == set(rows)


def test_exponent_meets_its_targets():
    sizes = [1000, 100, 50]
    a = mixing.exponent(sizes, 0.9, 100)
    powers = np.array(sizes, float) ** a
    w = powers / powers.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * np.log(3))
    a = mixing.exponent(sizes, 0.99, 2)
    assert (1000 / 50) ** (1 - a) == pytest.approx(2)
    assert mixing.exponent([5], 0.9, 2) == mixing.exponent([], 0.9, 2) == 1.0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, folder).toPandas(), oracle_frame(queries.ORACLES[name], folder)) is None


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name == "toxicity":
            assert ids - now <= toxic
        if name in ("suffix_array_dedup", "mixing"):
            assert now == ids
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert set(packed.doc_id) == ids
    assert set(corpus_pipeline.run(spark, folder).toPandas().doc_id) == ids


def test_pipeline_stages_against_brute_force(spark, documents, tmp_path):
    import duckdb
    import xxhash

    import test_texts as T

    pairs = [*T.corpus(), *((1000 + i, f"{'venom spite' if i % 2 else 'garden tea'} {T.prose(5000 + i, 20)}") for i in range(120))]
    labels = [(1000 + i, i % 2) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(pairs, source=lambda i: "small" if i is None or i < 60 else "big").select("doc_id", "text", "lang", "source", "n_chars")
    stages, key = dict(corpus_pipeline.STAGES), lambda r: (r[0] is not None, r[0] or 0, r[1] or "")

    def after(name):
        out = corpus_pipeline.materialize(stages[name](spark, docs, str(tmp_path)), name)
        return out, sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)

    features, texts = toxicity.Features(), dict(pairs)
    known = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    known.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[0]))
    bias, places, weights = toxicity.train([(np.unique(features.of(texts[d])), y) for d, y in known])
    weight = dict(zip(places.tolist(), weights.tolist()))
    total = lambda t: bias + sum(weight.get(f, 0.0) for f in set(features.of(t).tolist()))
    want = sorted((r for r in pairs if 1 / (1 + np.exp(-total(r[1]))) < toxicity.THRESHOLD), key=key)
    docs, got = after("toxicity")
    assert got == want and {r[0] for r in pairs} - {r[0] for r in got} == {d for d, y in labels if y}

    sets, group = [T.shingle_sets(t, 5) for _, t in got], list(range(len(got)))
    for a in range(len(got)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    want = [(d, t or "") for i, (d, t) in enumerate(got) if group.index(group[i]) == i]  # in order of id, null first; null texts become empty
    assert len(want) < len(got)
    docs, got = after("ngram_jaccard_join")
    assert got == want

    want = {d: (n - gone, sha) for d, n, gone, _, sha in T.brute_removal(got)}
    assert any(n < len((t or "").encode()) for (n, _), (_, t) in zip((want[-1 if d is None else d] for d, _ in got), got))
    docs, got = after("suffix_array_dedup")
    assert {-1 if d is None else d: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for d, t in got} == want
    assert len(got) == len(want) and all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        times = dict(db.execute(f"SELECT doc_id, count(*) FROM ({mixing.ORACLE}) GROUP BY doc_id").fetchall())
    want = [r for r in got for _ in range(times[r[0]])]
    docs, got = after("mixing")
    assert got == want and len(want) > len(times)

    tokenizer = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    sizes = collections.Counter((-1 if d is None else d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in got)
    pieces = stages["packing"](spark, docs, str(tmp_path)).toPandas()
    pieces["doc_id"] = pieces.doc_id.fillna(-1).astype(int)
    assert collections.Counter(map(tuple, pieces[pieces.start == 0][["doc_id", "doc_tokens"]].values.tolist())) == sizes
    assert pieces.length.sum() == sum(n * times for (_, n), times in sizes.items()) and pieces.groupby("sequence_id").length.sum().max() <= 2048
