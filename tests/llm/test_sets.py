"""Exact and near duplicates, decontamination, sharding: against brute force on small tables."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import duckdb  # noqa: F401
from quire.llm import decontam, exact_dedup, sharding, simhash
from quire.llm.common import table
from quire.llm.components import connected_components
from quire.llm.decontam import words_of
from quire.llm.queries import oracle_sql, queries
from tests.llm import brute
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SF_01 = "/root/testdata/sf0.01"
NULL_LAST = lambda i: (i is None, i)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("sf", [SF, SF_01])
def test_query_matches_sql(spark, name, sf):
    line = compare(spark, duck(sf), name, queries()[name], oracle_sql()[name], sf)
    assert line.startswith("OK"), line


def rows_path(df, tmp_path, files=5):
    path = str(tmp_path / "docs.parquet")
    df.repartition(files).write.parquet(path)
    return path


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup_odd_rows(spark, odd, odd_rows, tmp_path, digest_bytes):
    """Also with one file a batch, and with a digest so short that texts collide."""
    t = exact_dedup.Table(rows_path(odd, tmp_path), digest_bytes=digest_bytes)
    got = exact_dedup.decisions(spark, t, maxFilesPerTrigger="1").collect()
    groups = defaultdict(list)
    for i, text, *_ in odd_rows:
        groups[text or ""].append(i)
    assert len(got) == len(odd_rows)
    by_text = defaultdict(list)
    for r in got:
        by_text[r["text_sha256"]].append(r)
    assert len(by_text) == len(groups)
    for text, ids in groups.items():
        rows = by_text[brute.sha(text)]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]


def test_exact_dedup_stage(spark, odd, odd_rows, none):
    got = exact_dedup.deduplicate(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert Counter(r["text"] or "" for r in rows) == Counter({r[1] or "" for r in odd_rows})
    assert exact_dedup.deduplicate(none).collect() == []


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Files that come later are hits against the state that an earlier run left."""
    path, work = str(tmp_path / "in"), str(tmp_path / "work")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    first.write.parquet(path)
    t = exact_dedup.Table(path)
    assert sorted(r["n"] for r in exact_dedup.retained(spark, t, work).collect()) == [1, 1]
    spark.createDataFrame([(9, "a"), (3, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    assert sorted((r["keep_id"], r["n"]) for r in exact_dedup.retained(spark, t, work).collect()) == [(2, 1), (3, 1), (9, 2)]


def test_many_batches_at_default_settings(spark, tmp_path, monkeypatch):
    """Three files of more than half a batch each: later batches look up keys that earlier ones left."""
    from pyspark.sql import functions as F

    body = F.concat(*[F.sha2(F.concat(F.col("id") % 60_000, F.lit(f"/{k}")), 512) for k in range(10)])
    path = str(tmp_path / "docs.parquet")
    docs = spark.range(0, 180_000, 1, 3).select(F.col("id").alias("doc_id"), body.alias("text"))
    docs.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    seen = []
    monkeypatch.setattr(exact_dedup, "work_folder", lambda spark, name: seen.append(str(tmp_path / name)) or seen[-1])
    got = exact_dedup.decisions(spark, exact_dedup.Table(path))
    assert got.agg(F.count(F.lit(1)), F.count_if("kept"), F.min("group_size"), F.max("group_size"), F.min("keep_id")).first() == (180_000, 60_000, 3, 3, 120_000)
    changed = spark.read.parquet(f"{seen[0]}/changed").where("batch >= 0")
    assert changed.select("batch").distinct().count() >= 2
    assert changed.groupBy("key").count().where("count > 1").count() == 60_000


def test_the_filter_loses_no_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 1 << 17)
    rows = spark.range(200_000).select(F.col("id").cast("string").cast("binary").alias("key"))
    keys = rows.where("hash(key) % 50 = 0")
    left = exact_dedup.with_filter(rows, keys)
    assert keys.join(left, "key", "left_anti").isEmpty()
    assert left.count() < 12_000


def test_codes_cover():
    for code in (simhash.GOLAY, simhash.HAMMING):
        at, errors = simhash.patterns(code, 0)[0]
        assert len(errors) == 1 << (code[1].bit_length() - 1) and (np.diff(at) == 1).all()


@pytest.mark.parametrize("codes", [[simhash.GOLAY, simhash.GOLAY], [simhash.GOLAY, simhash.GOLAY, simhash.HAMMING]])
def test_pairs_within_threshold_share_a_home(codes):
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        flips = rng.choice(64, 2, replace=False)
        b = np.int64(a)
        for f in flips:
            b ^= np.int64(np.uint64(1 << int(f)).astype(np.int64))
        home = [int(x) for w, x, h in simhash.anchors(np.array([a], np.int64), codes, 2) if h for x in x]
        seen = {int(x) for w, xs, h in simhash.anchors(np.array([b], np.int64), codes, 2) for x in xs}
        assert len(home) == 1 and home[0] in seen


@pytest.mark.parametrize("third_from", [simhash.THIRD_BLOCK_FROM, 1])
def test_links_equal_brute_force(spark, monkeypatch, third_from):
    """Also with the third block of anchors."""
    monkeypatch.setattr(simhash, "THIRD_BLOCK_FROM", third_from)
    rng = np.random.default_rng(3)
    centres = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = set()
    for c in centres:
        for k in range(12):
            x = int(c) & (2**64 - 1)
            for f in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(f)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 500 + i) for i in range(1, 80)] + [(900, 901), (901, 902), (902, 900), (902, 902), (950, 950), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {500 + i: 500 for i in range(80)} | {900: 900, 901: 900, 902: 900}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("source", ["odd", "sf"])
def test_simhash_equals_brute_force(spark, request, source):
    df = request.getfixturevalue("odd") if source == "odd" else table(spark, SF_01, "documents")
    rows = [(r["doc_id"], brute.fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    ids = brute.components(rows)
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", ids[f]) for i, f in rows)


def test_simhash_stage_keeps_one_each(spark, odd, none):
    rows = [(r["doc_id"], brute.fingerprint(r["text"])) for r in odd.select("doc_id", "text").collect()]
    # a component by its smallest fingerprint: ids may be null or used twice
    root = brute.components([(f, f) for _, f in rows])
    ids = {}
    for i, f in rows:
        ids.setdefault(root[f], set()).add(i)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = [(r["doc_id"], root[brute.fingerprint(r["text"])]) for r in kept.select("doc_id", "text").collect()]
    assert sorted(f for _, f in got) == sorted(ids)
    assert all(i == min(ids[f] - {None}, default=None) for i, f in got)
    assert simhash.keep_one(none).collect() == [] and simhash.near_duplicates(none).collect() == []


WORDS = [f"w{i}" for i in range(400)]
ITEMS = [(1, " ".join(WORDS[:20])), (2, " ".join(WORDS[100:113])), (3, "Lone"), (4, " ".join(WORDS[5:18]).upper()), (5, None), (6, ""), (7, "a b c"), (1, " ".join(WORDS[:20])), (None, " ".join(WORDS[200:220])), (30, "Éclair ÉCLAIR x"), (8, " ".join(["la"] * 20))]
TEXTS = [
    " ".join(WORDS[:20]), " ".join(WORDS[1:13]), ("x " * 500) + " ".join(WORDS[3:17]) + " y" * 20, "lone", "Lone, lone; LONE!", "a-b c a b c",
    None, "", "...", " ".join(WORDS[200:220]), " ".join(WORDS[95:120]) + " z " + " ".join(WORDS[:14]), "Éclair ÉCLAIR x", "éclair Éclair x",
    "la " * 15, "la " * 12, " ".join(WORDS[100:112]), ("pad " * 3000) + " ".join(WORDS[100:113]),
]


@pytest.mark.parametrize("block_bytes,shard_words", [(1 << 20, 1 << 20), (60, 7)])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_bytes, shard_words):
    items = [(a, b) for a, b in ITEMS]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, found_ string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("x"))
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard_words)
    got = decontam.find(docs, "text", bench, block_bytes=block_bytes)
    real = [(a, b) for a, b in items if a is not None]
    for r in got.select("doc_id", "text", "found", decontam.n_hit(F.col("found")).alias("h"), decontam.is_contaminated(F.col("found")).alias("c")).collect():
        n, hit, ids = brute.contamination(r["text"], real)
        f = r["found"]
        assert (f["n_words"], r["h"], sorted(f["items"])) == (n, hit, sorted(ids)), (r, n, hit, ids)
        assert r["c"] == (hit > 0 and 20 * hit >= n)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns


def test_decontamination_longest_match(spark):
    docs = spark.createDataFrame([(0, "q " + " ".join(WORDS[2:18]) + " q"), (1, "q q")], "doc_id long, text string")
    rows = {r["doc_id"]: r["found"] for r in decontam.find(docs, "text", spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert (rows[0]["longest"], rows[0]["longest_at"], rows[0]["longest_item"]) == (16, 1, "1") and rows[0]["spans"] == [1, 16]
    assert rows[1]["longest"] == 0 and rows[1]["longest_item"] is None


def test_decontamination_longest_match_below_a_window(spark):
    """Also where no whole window occurs: 12 words of an item, and a single one."""
    docs = spark.createDataFrame([(0, "q q " + " ".join(WORDS[1:13]) + " q w5 w6"), (1, "q w110"), (2, "w5 w7 q"), (3, "q")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 60):
        rows = {r["doc_id"]: r["found"] for r in decontam.find(docs, "text", bench, block_bytes=block_bytes).collect()}
        got = [(rows[i]["longest"], rows[i]["longest_at"], rows[i]["longest_item"]) for i in range(4)]
        assert got[:3] == [(12, 2, "1"), (1, 1, "2"), (1, 0, "1")] and got[3][::2] == (0, None)
        assert all(rows[i]["spans"] == [] and rows[i]["items"] == [] for i in range(4))


def test_decontamination_benchmark_stays_off_the_driver(spark, monkeypatch):
    """Items go from Spark to block files; however many blocks there are, the texts pass through Python once."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **b: pytest.fail("items fetched by the driver"))
    files = decontam.blocks(bench, 60)
    got = decontam.find(docs, "text", bench, block_bytes=60)
    assert len(files) > 4 and got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    written = spark.read.parquet(files[0].rsplit("/", 2)[0]).groupBy("block").agg(F.sum(4 * F.length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert len(written) == len(files) and all(r["b"] <= 60 or r["n"] == 1 or r["b"] == 0 for r in written)


def test_decontamination_odd_and_empty(odd, odd_rows, none):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text").where("length(text) < 500")
    found = decontam.find(odd, "text", bench).select("found", decontam.is_contaminated(F.col("found")).alias("c")).collect()
    assert len(found) == len(odd_rows) and all(r["c"] is not None for r in found)
    assert all(r["found"]["items"] == [] for r in decontam.find(odd, "text", bench.where("false")).select("found").collect())
    assert decontam.decontaminate(none, bench).collect() == []


def test_decontamination_null_item_ids(spark, tmp_path):
    """The query equals its SQL on a benchmark with null ids, and the stage drops the copies."""
    texts = [" ".join(WORDS[200:220]), " ".join(WORDS[195:225]) + " lone", "pad " * 900 + " ".join(WORDS[200:213]), "other words", None]
    sf = str(tmp_path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(ITEMS + [(None, "two nulls"), (None, " ".join(WORDS[199:215])), (None, None)], "item_id long, text string").coalesce(1)
    docs.toPandas().astype({"doc_id": "int64"}).to_parquet(f"{sf}/documents.parquet")
    bench.toPandas().astype({"item_id": "Int64"}).to_parquet(f"{sf}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    line = compare(spark, con, "op8_decontamination", queries()["op8_decontamination"], oracle_sql()["op8_decontamination"], sf)
    assert line.startswith("OK"), line
    found = {r["doc_id"]: r["found"]["items"] for r in decontam.find(docs, "text", bench, null_ids=True).select("doc_id", "found").collect()}
    assert found == {0: [None], 1: ["3", None], 2: [None], 3: [], 4: []}
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 3, 4]


def test_decontamination_with_long_items(odd, odd_rows):
    """The unfiltered rows as the benchmark: one item has 189,000 words."""
    bench = odd.select(F.col("doc_id").alias("item_id"), "text")
    real = [(r[0], r[1]) for r in odd_rows if r[0] is not None]
    texts = {r[0]: r[1] for r in odd_rows if r[0] in (0, 39, 400, 403)}
    rows = {r["doc_id"]: r for r in decontam.find(odd, "text", bench).select("doc_id", "found", decontam.n_hit(F.col("found")).alias("h")).collect()}
    for i, text in texts.items():
        n, hit, ids = brute.contamination(text, real)
        assert (rows[i]["found"]["n_words"], rows[i]["h"], set(rows[i]["found"]["items"])) == (n, hit, ids), i
    assert rows[400]["found"]["longest"] == 189_000 and rows[400]["found"]["longest_item"] == "400"


def test_benchmark_memory_is_linear():
    words = [f"v{i * 7919 % 5003}" for i in range(20_000)]
    text = " ".join(words)
    tracemalloc.start()
    try:
        bench = decontam.Benchmark([("1", text)] + [(str(i), f"some shared words {i}") for i in range(2, 300)], 13)
        (_, _, a, at_a, _), (marks, items, b, at_b, item) = decontam.search([words_of(text), words_of("x " + text[7:] + " y " + text)], bench)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (a, at_a, b, items, bench.ids[item]) == (20_000, 0, 20_000, {0}, "1") and at_b > 19_000
    assert peak < 100 << 20, peak


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 4, 300).astype(np.int32)
    order = decontam.suffix_array(w, np.arange(300), 300)
    assert [tuple(w[i:]) for i in order] == sorted(tuple(w[i:]) for i in range(300))


def check_shards(rows, texts, shards, tolerance):
    slots = defaultdict(list)
    sizes = Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(sizes.values()) / shards
    assert max(abs(sizes[s] - mean) for s in range(shards)) <= tolerance * mean, sorted(sizes.values())
    return sizes


def test_sharding_keeps_groups_and_balances(spark):
    docs = table(spark, SF_01, "documents")
    rows = sharding.shard_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check_shards(rows, texts, 24, 0.03)
    where = defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_sharding_cuts_a_group_larger_than_a_shard(spark):
    rows = [(i, "hot text " * 20) for i in range(3000)] + [(10_000 + i, f"{i} other {'words ' * (i % 60)}") for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)
    check_shards(got, None, 24, 0.05)


def shard_sizes(rows, shards=24):
    sizes = [0] * shards
    for r in rows:
        sizes[r["shard"]] += r["size"]
    return sizes


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_sharding_cuts_a_group_whatever_its_ids(spark, ids):
    """A third of all rows has one text of more bytes than a shard, with null ids, one id or ids of their own."""
    rows = [(i, f"text number {i:05d} of the others") for i in range(2400)]
    rows += [({"null": None, "one": 7, "own": 10_000 + i}[ids], "x" * 41) for i in range(1200)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    check_shards(got, None, 24, 0.05)


def test_sharding_keeps_a_short_hot_group_whole(spark):
    """Many rows with few bytes fit on one shard: they stay together, and sizes are still near equal."""
    rows = [(i, f"{i} " + "long text " * (40 + i % 30)) for i in range(2400)] + [(10_000 + i, None if i % 2 else "") for i in range(1200)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    check_shards(got, None, 24, 0.03)
    assert len({r["shard"] for r in got if r["doc_id"] >= 10_000}) == 1


def test_sharding_equals_a_plain_packer(spark):
    """Every heavy group goes where a plain vector packer finds the highest dot product, along the whole
    way, and the rows of the table follow those placings."""
    rows = [(i, "abc " * (i % 37 + 1) + str(i // 3)) for i in range(300)]
    groups, total, _ = sharding.groups_of(sharding.measured(spark.createDataFrame(rows, "doc_id long, text string")), 24)
    size = {}
    for _, t in rows:
        b, w, r = size.get(t, (0, 0, 0))
        size[t] = (b + len(t) + 8, w + len(t.split()), r + 1)
    assert total == [sum(g[d] for g in size.values()) for d in range(3)]
    assert sorted((r["bytes"], r["tokens"], r["rows"]) for r in groups.collect()) == sorted(size.values())
    vectors = sorted(([x / n for x, n in zip(g, total)] for g in size.values()), key=max, reverse=True)
    placed, _ = sharding.place_heavy(np.array(vectors), np.zeros(3), 24)
    load, left = [[0.0] * 3 for _ in range(24)], [1.0, 1.0, 1.0]
    for group, chosen in zip(vectors, placed):
        caps = [[0.0] * 3 for _ in range(24)]
        for d in range(3):
            lo, hi = min(x[d] for x in load), 2.0
            for _ in range(60):  # the water level, by bisection
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(max(mid - x[d], 0) for x in load) < left[d] else (lo, mid)
            above = d and any(hi - x[d] < -1e-12 for x in load)
            for s in range(24):
                caps[s][d] = caps[s][0] * left[d] / max(sum(c[0] for c in caps), 1e-300) if above else max(hi - load[s][d], 0)
            if above:
                caps = [[c[0], *(c[0] * left[d] / max(sum(x[0] for x in caps), 1e-300) if e == d else c[e] for e in (1, 2))] for c in caps]
        dots = [sum(c * g for c, g in zip(cap, group)) for cap in caps]
        assert dots[chosen] > max(dots) - 1e-9
        load[chosen] = [x + g for x, g in zip(load[chosen], group)]
        left = [x - g for x, g in zip(left, group)]
    sizes = shard_sizes(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert np.allclose(sorted(sizes), sorted(x[0] * total[0] for x in load), rtol=0.02)


def test_sharding_parts_agree(spark, monkeypatch):
    monkeypatch.setattr(sharding, "pack", lambda g, t, s, pack=sharding.pack: pack(g, t, s, groups_per_part=500))
    monkeypatch.setattr(sharding, "numbered", lambda r, numbered=sharding.numbered: numbered(r, rows_per_part=300))
    rows = [(i, f"{i} text {'words ' * (i * 7919 % 90)}") for i in range(5000)]
    check_shards(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), None, 24, 0.03)


def test_sharding_odd_rows(odd, odd_rows, none):
    got = sharding.shard_documents(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(none).collect() == []


def test_words_are_counted(spark):
    texts = ["", None, "a", " a b ", "a\t\tb\nc", "  ", "é ü\r\nx"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(sharding.tokens(F.col("text"))).collect()]
    assert got == [0, 0, 1, 2, 3, 0, 3]
