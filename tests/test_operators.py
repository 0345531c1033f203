"""Operators on literal rows, and invariants."""

import json

import pytest
from pyspark.sql import functions as F

from granary.functions.text import dedup_key
from granary.operators import balance, dedup, metrics, near, providers, quality, sampling
from granary.sources import readers, writers
from granary.streaming import incremental


@pytest.fixture
def strata(spark):
    return spark.createDataFrame([(i, "a" if i < 97 else "b" if i < 99 else "c", f"text {i}") for i in range(100)], "id bigint, k string, t string")


def test_dedup_keys(spark):
    df = spark.createDataFrame([(3, "What is 2+2?"), (1, "what is 2+2? "), (2, "What is  2+2?"), (4, " "), (5, None)], "seq bigint, q string")
    ids = lambda d: sorted(r.seq for r in d.collect())
    assert ids(dedup.first_of_key(df, dedup_key(F.col("q"), False), "seq")) == [1, 2, 3]
    assert ids(dedup.first_of_key(df, dedup_key(F.col("q")), "seq")) == [1, 2]
    again = dedup.first_of_key(dedup.first_of_key(df, dedup_key(F.col("q")), "seq"), dedup_key(F.col("q")), "seq")
    assert ids(again) == [1, 2]
    assert tuple(dedup.duplicate_counts(df, dedup_key(F.col("q"))).first()) == (2, 3, 0.6)
    assert dedup.duplicate_counts(df.limit(0), F.col("q")).first().rate is None
    new = dedup.new_rows(df, spark.createDataFrame([("what is  2+2?",)], "q string"), dedup_key(F.col("q")), dedup_key(F.col("q")), "seq")
    assert ids(new) == [1] and new.columns == ["seq", "q"]


def test_except_by_value_removes_all_copies(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "x string, y int")
    assert [tuple(r) for r in dedup.except_by_value(df, df.filter("x = 'a'").limit(1)).collect()] == [("b", 1)]


def test_allocation_and_sample_sizes(strata):
    assert {r.k: r.alloc for r in sampling.allocation(strata, ["k"], 10).collect()} == {"a": 9, "b": 1, "c": 1}
    split = sampling.stratified_split(strata, ["k"], 10, 1, "id")
    assert split.filter("is_test").count() == 11 and split.count() == 100
    sample = sampling.stratified_sample(strata, ["k"], 10, 1, "id")
    assert sample.count() == 10 and sample.select("id").distinct().count() == 10
    assert sampling.stratified_sample(strata, ["k"], 50, 1, "id").count() == 50
    assert sampling.stratified_sample(strata, ["k"], 500, 1, "id").count() == 100
    assert sampling.simple_sample(strata, 7, 1, "id").count() == 7


def test_permutation_and_batches(strata):
    rows = sampling.batches(sampling.permuted(strata, 3, "id"), 32).collect()
    assert sorted(r.pos for r in rows) == list(range(100)) and [r.pos for r in sorted(rows, key=lambda r: r.id)] != list(range(100))
    assert sum(r.batch == 3 for r in rows) == 4


def test_caps_quotas_targets(spark, strata):
    assert sampling.cap_per(strata, 5, ["k"], 1, "id").count() == 8
    quotas = spark.createDataFrame([("a", 3), ("b", 9), ("z", 1)], "k string, quota int")
    assert sampling.quota_per(strata, quotas, ["k"], 9, 1, "id").count() == 5
    over = sampling.until_target(strata.withColumn("b", F.expr("id div 10")), ["k"], "b", 15)
    assert over.filter("k = 'a'").count() == 20


def test_episodes_are_disjoint_or_drawn_again(strata):
    got = sampling.episodes(strata, "k", 3, 5, 10, 1, 0, "id").collect()
    assert len(got) == 45
    a = [r for r in got if r.k == "a"]
    assert len({r.id for r in a}) == 15 and sum(r.role == "support" for r in a) == 5
    assert sampling.steps_per_epoch(1000, 4, 5, 10) == 16


def test_latest_checkpoint_is_by_number(spark):
    df = spark.createDataFrame([("o/checkpoint-900",), ("o/checkpoint-1000",), ("o/other",)], "path string")
    assert sampling.latest_checkpoint(df).first().path == "o/checkpoint-1000"


def test_balance(spark):
    assert tuple(spark.range(1).select(*balance.required_counts(F.lit(60000))).first()) == (59210, 789)
    df = spark.createDataFrame([("Coding", "easy")] * 3 + [("Coding", "hard")], "domain string, difficulty string")
    plan = {(r.domain, r.difficulty): r for r in balance.gap_plan(df, balance.quota_table(spark), ["domain", "difficulty"]).collect()}
    assert len(plan) == 16 and plan["Coding", "hard"].gap == 129 and plan["Coding", "hard"].request == 219 and plan["Coding", "hard"].batches == 11
    assert balance.token_balance(df.limit(0), F.col("difficulty")).first().easy_percent is None


def test_losses_smeared_over_batches(spark):
    df = spark.createDataFrame([(0, "e", 1.0), (1, "h", 3.0), (2, "e", 1.0), (3, "e", 3.0), (4, "h", 5.0)], "seq bigint, d string, l double").withColumn("b", F.expr("seq div 4"))
    got = {r.key: (r["count"], r.avg_loss) for r in metrics.evaluate_by(df, "l", F.col("d"), "b").collect()}
    assert got == {"e": (3, 2.0), "h": (2, 3.5)}
    assert metrics.evaluate(df, "l").first().avg_loss == 2.6
    assert metrics.compare(metrics.evaluate(df, "l"), metrics.evaluate(df, "l")).first().equal


def test_early_stop(spark):
    df = spark.createDataFrame(list(enumerate([3.0, 2.0, 2.5, 2.2, 1.9, 2.0, 2.0])), "s int, l double")
    got = [(r.waited, r.stop) for r in metrics.early_stop(df, "s", "l", 2).orderBy("s").collect()]
    assert got == [(0, False), (0, False), (1, False), (2, True), (0, True), (1, True), (2, True)]


def test_quality_stats(spark):
    df = spark.createDataFrame([("p", "<b>r</b>", "medium"), ("", None, None)], "prompt string, response string, d string")
    r = quality.cleaned_stats(df, "prompt", "response", F.col("d")).first()
    assert (r.total, r.easy, r.other, r.missing_prompt, r.missing_response, r.has_markup, r.avg_length) == (2, 1, 1, 1, 1, 1, 4.0)
    assert quality.cleaned_stats(df.limit(0), "prompt", "response", F.col("d")).first().avg_length == 0
    with pytest.raises(ValueError, match="missing_response"):
        quality.assert_complete(df, "prompt", "response", "d")
    with pytest.raises(ValueError, match="domain"):
        quality.assert_fields(df, "prompt", "domain")


def test_minhash_links_and_cosine(spark):
    w = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w + ["x"])), (3, "other words"), (4, None)], "id bigint, t string")
    assert [(r.id, r.leader) for r in near.minhash_links(df, "id", "t").collect()] == [(2, 1)]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id bigint, v array<double>")
    assert {(r.query_id, r.id) for r in near.cosine_links(v, "id", "v", v.filter("id = 0"), 0.9).collect()} == {(0, 0), (0, 1)}


def test_providers(spark):
    df = spark.createDataFrame([(i, f"q{i}") for i in range(30)], "i int, q string")
    assert {r.answer for r in providers.apply_provider(df, "q", providers.echo).collect()} == {f"Q{i}" for i in range(30)}
    calls = []

    def picky(prompts):
        calls.append(len(prompts))
        if len(prompts) > 1:
            raise RuntimeError
        return ["ok"] if prompts[0] != "bad" else [None]

    assert providers.halving(picky)(["a"] * 11 + ["bad"]) == ["ok"] * 11 + [None] and calls[0] == 12
    assert providers.halving(lambda p: ["x"])(["a", "b"]) == ["x", None]
    tries = []

    def flaky(p):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return p

    assert providers.with_retry(flaky, 3, 0)(["a"]) == ["a"]
    tokens = providers.tokenize(df.limit(1), "q", lambda t: list(range(len(t))), 4, pad=9).first().input_ids
    assert tokens == [0, 1, 9, 9]
    tables, rows = providers.run_until(lambda m: df if m else df.limit(0), 50, models=2)
    assert rows == 60 and len(tables) == 2
    assert providers.run_until(lambda m: df.limit(0), 50)[1] == 0


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"question": "a"}\n\n{bad\n{"question": "b", "domain": "Math"}\n')
    schema = "question string, domain string"
    assert readers.jsonl(spark, str(p), schema, "drop").count() == 2
    assert readers.jsonl(spark, str(p), schema, "keep").filter("_corrupt_record is not null").count() == 1
    assert tuple(readers.bad_lines(spark, str(p), schema).select("bad", "lines").first()) == (1, 3)
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p), schema).collect()
    (tmp_path / "t.tsv").write_text("question\tanswer\nq\t1\n")
    assert readers.tsv(spark, str(tmp_path / "t.tsv"), "question string, answer string").first().answer == "1"
    name, df = readers.first_available(spark, ("x", str(tmp_path / "no")), ("y", str(p)), read=lambda q: readers.jsonl(spark, q, schema, "drop"))
    assert name == "y" and df.count() == 2
    assert readers.shards(spark, {"a": str(p), "b": str(tmp_path / "no")}, lambda q: readers.jsonl(spark, q, schema, "drop")).first().subject == "a"
    for i in range(2):
        (tmp_path / f"checkpoint_{i}.jsonl").write_text('{"question": "a"}\n{"question": "b"}\n')
    assert readers.checkpoints(spark, f"{tmp_path}/checkpoint_*.jsonl", schema, dedup_key(F.col("question"))).count() == 2
    quota = readers.quota_rows(readers.with_seq(readers.jsonl(spark, str(p), schema, "drop")), F.coalesce("domain", F.lit("none")), {"none": 1, "Math": 0})
    assert [r.question for r in quota.collect()] == ["a"]
    assert readers.env_file("A=1\n# c\n\nB = 'x'\n") == {"A": "1", "B": "x"}
    out = tmp_path / "out"
    writers.split(df, F.col("question") == "a", f"{out}/train", f"{out}/test", str(p), f"{out}/backup.jsonl")
    assert spark.read.json(f"{out}/train").count() == 1 and (out / "backup.jsonl").read_text() == p.read_text()
    writers.routed(df.fillna("none"), f"{out}/routed", "domain")
    assert (out / "routed" / "domain=Math").is_dir()
    writers.row_document(df.agg(F.count(F.lit(1)).alias("n")), f"{out}/m.json")
    assert json.loads((out / "m.json").read_text()) == {"n": 2} and writers.size_bytes(spark, f"{out}/m.json") > 0
    assert readers.json_document(spark, f"{out}/m.json", "n bigint").first().n == 2


def test_micro_batches_with_ledger(spark, tmp_path):
    for i, rows in enumerate([[(1, "a"), (2, "b"), (3, "A ")], [(4, "b"), (5, "c")]]):
        spark.createDataFrame(rows, "seq bigint, q string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    args = dict(key=dedup_key(F.col("q")), seq="seq", out=f"{tmp_path}/out", ledger=f"{tmp_path}/ledger", checkpoint=f"{tmp_path}/cp")
    run = lambda: incremental.process_pending(incremental.files(spark, f"{tmp_path}/in/*", "seq bigint, q string"), lambda b: b.withColumn("done", F.lit(True)), **args).awaitTermination()
    run()
    keys = lambda: sorted(r.q.strip().lower() for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert keys() == ["a", "b", "c"]
    spark.createDataFrame([(6, "c"), (7, "d")], "seq bigint, q string").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    assert keys() == ["a", "b", "c", "d"]


def test_ledger_query_over_files_in_any_order(spark, tmp_path):
    """Files whose ids decrease, interleave and are null; null and empty texts are keys."""
    import os

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from granary.plans.catalogue import ORACLES, QUERIES

    batches = [[(7, "a"), (8, "B"), (None, "n"), (9, ""), (21, "only")], [(5, " A"), (6, None), (20, "b\u3000"), (4, "n"), (40, "\nA"), (41, "ΣΑΣ")], [(3, "a"), (30, "A"), (2, " "), (1, None), (None, "null id"), (10, "a"), (39, "σασ")]]
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    for i, rows in enumerate(batches):
        doc_id, texts = zip(*rows)
        pq.write_table(pa.table({"doc_id": pa.array(doc_id, pa.int64()), "text": texts, "lang": ["en"] * len(rows), "source": ["web"] * len(rows), "n_chars": [1] * len(rows)}), folder / f"{9 - i}.parquet")
        os.utime(folder / f"{9 - i}.parquet", (1000 + i, 1000 + i))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(QUERIES["stream_dedup_ledger"](spark, str(tmp_path)).select("seq", "key").collect()) == order(con.execute(ORACLES["stream_dedup_ledger"]).fetchall())


def test_streaming_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in incremental.windowed_counts(df, "ts", "k").collect()) == [1, 2]
    assert sorted(r.n for r in incremental.sessions(df, "ts", "k", "30 minutes").collect()) == [1, 2]
    assert incremental.distinct_stream(df, F.col("k")).count() == 1


def test_contaminated_by_key_and_by_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(item,), ("short one",), ("",), (None,)], "t string")
    docs = spark.createDataFrame([(1, f"x{item}y"), (2, item.replace("zeta", "ZETA")), (3, "a short one"), (4, None), (5, "")], "id bigint, t string")
    assert sorted(r.id for r in near.contaminated(docs, items, "id", "t", "t").collect()) == [1, 3]
    with pytest.raises(ValueError):
        near.contaminated(docs, items, "id", "t", "t", most_items=0)


def test_links_of_drifting_versions_are_whole(spark, monkeypatch):
    """Long series of versions, copies and unlike texts against brute force; also with groups cut into blocks."""
    import random

    from granary.operators import links

    rng = random.Random(3)
    rows = []
    for series in range(3):
        w = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for v in range(120):
            rows.append((series * 1000 + v, " ".join(w)))
            w[rng.randrange(100)] = f"w{rng.randrange(5000)}"
    rows += [(5000 + i, rows[i * 7][1].upper()) for i in range(10)] + [(6000 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(7000, None), (7001, ""), (None, rows[0][1])]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(i, first[s]): 1.0 for i, s in sets.items() if first[s] != i}
    for s, i in first.items():
        for o, j in first.items():
            if j < i and (same := len(s & o) / len(s | o)) >= 0.8:
                want[i, j] = same
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    for most in (links.MOST, 4000):
        monkeypatch.setattr(links, "MOST", most)
        got = {(r.id, r.leader): r.similarity for r in near.minhash_links(df, "id", "t").collect()}
        assert got == pytest.approx(want)


def test_ascii_json_is_as_pythons(spark):
    from granary.functions.text import ascii_json

    texts = ["plain", "é\n\"q\" \\", "😀 and \x7f", "", "日本 $1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_json(F.to_json(F.struct("t"))).alias("j"))
    for r in rows.collect():
        assert r.j.isascii() and "\x7f" not in r.j and json.loads(r.j) == {"t": r.t}


def test_functions_of_ones_own(spark):
    rows = spark.createDataFrame([(2**60 + 1, None), (2**60 + 3, "a b"), (None, "c"), (None, "")], "id bigint, t string")
    got = providers.table_function(rows, ["id"], "t", lambda t: [(w,) for w in (t or "").split()], "w string")
    assert sorted((str(r.id), r.w) for r in got.collect()) == [(str(2**60 + 3), "a"), (str(2**60 + 3), "b"), ("None", "c")]
    count = lambda v: b"%d" % len(v)
    got = providers.aggregate_function(rows, "id", "t", count, lambda a, b: b"%d" % (int(a) + int(b)))
    assert {(r.id, int(r.state)) for r in got.collect()} == {(str(2**60 + 1), 1), (str(2**60 + 3), 1), (None, 2)}
    assert providers.aggregate_function(rows.limit(0), "id", "t", count, lambda a, b: a).count() == 0


def test_filters_of_rows(spark):
    rows = spark.createDataFrame([("x" * 10, " a ", "EASY"), ("short", "a", "hard"), (None, " ", None)], "t string, d string, k string")
    got = rows.select(quality.long_enough(F.col("t")), quality.complete(F.col("t"), F.col("d")), quality.of_kinds(F.col("k"), "easy")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, False), (False, False, False)]
    assert quality.serializable(rows).count() == 3


def test_mixed_tasks_are_disjoint(spark):
    rows = spark.createDataFrame([(i, "d", "easy" if i % 2 else "hard") for i in range(40)] + [(99, "few", "hard")], "id bigint, d string, k string")
    got = sampling.mixed_tasks(rows, "d", F.col("k"), {"easy": 3, "hard": 1}, 1, "id").collect()
    assert len({r.id for r in got}) == len(got) == 9
    assert sorted((r.role, r.kind) for r in got if r.d == "d") == [("query", "easy")] * 3 + [("query", "hard")] + [("support", "easy")] * 3 + [("support", "hard")]
    assert [r.role for r in got if r.d == "few"] == ["support"]


def test_a_broken_source_is_passed_over(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    (tmp_path / "good.json").write_text('{"a": 2}\n')
    paths = {n: str(tmp_path / f"{n}.json") for n in ("bad", "good", "none")}
    read = lambda p: readers.jsonl(spark, p, "a int")
    name, rows = readers.first_available(spark, *paths.items(), read=read)
    assert name == "good" and [r.a for r in rows.collect()] == [2]
    assert [(r.a, r.subject) for r in readers.shards(spark, paths, read).collect()] == [(2, "good")]
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, ("bad", paths["bad"]), read=read)


def test_no_temporary_folder_on_a_cluster():
    from types import SimpleNamespace

    from granary.session import shared_dir

    there = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared_dir(there("spark://host:7077", None))
    assert shared_dir(there("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(there("local[4]", None))
