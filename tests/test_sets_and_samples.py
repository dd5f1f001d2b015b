import pytest
from pyspark.sql import functions as F

from corvane.operators import duplicates as D
from corvane.operators import models as M
from corvane.operators import retrieval as R
from corvane.operators import sampling as Z
from corvane.sources import files as FS
from corvane.streaming import logs as T


def test_consistent_sampling(spark):
    t = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, t), (2, t), (3, "too short")], "id int, t string")
    s = D.shingle_table(df, "id", "t", mod=8)
    sets = {r.id: set(r.h) for r in s.groupBy("id").agg(F.collect_set("h").alias("h")).collect()}
    assert sets[1] == sets[2] and 0 < len(sets[1]) < 293 and 3 not in sets


def test_containment(spark):
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:60])), (3, "other " * 20)], "id int, t string")
    got = D.containment_pairs(D.shingle_table(df, "id", "t"), "id").collect()
    assert [(r.a, r.b, r.containment) for r in got] == [(1, 2, 1.0)]


def test_greedy_order(spark):
    nodes = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3), ("e", 4)], "g string, id long")
    edges = spark.createDataFrame([("d", 1, 2, 0.95), ("d", 2, 3, 0.95)], "g string, a long, b long, cosine double")
    got = {r.id: (r.kept, r.dropped_by) for r in D.greedy_keep(nodes, edges, "id", "g").collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None)}


def test_similar_titles(spark):
    df = spark.createDataFrame([(1, "Responsible AI in Education"), (2, "Responsible AI in education!"), (3, "Something else entirely"), (4, "AI")], "id int, t string")
    assert [(r.a, r.b) for r in D.similar_titles(df, "id", "t").collect()] == [(1, 2)]


def test_similar_titles_are_those_of_all_pairs(spark, monkeypatch):
    import difflib
    import random

    draw = random.Random(5)
    titles = ["introductiom to machine learming methods for young studemts", "imtroduction to machine learning methods for young students", "abcdefghijklmnopqr", "abcdefghijklmnopqrstuv", "chapter 12", "short"]
    for _ in range(40):
        base = [draw.choice("abcdeilnorst ") for _ in range(draw.randint(14, 60))]
        for _ in range(3):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = draw.choice(["", "x", "e", "th"])
            titles.append(" ".join("".join(copy).split()))
    titles += titles[:2]  # equal titles
    df = spark.createDataFrame(list(enumerate(titles)), "id int, t string")
    norm = {r.id: r.t for r in df.select("id", D.X.normalize_title("t").alias("t")).collect()}
    ok = [k for k in sorted(norm) if len(norm[k]) >= 12]
    want = {(a, b): x for a in ok for b in ok if a < b and (x := difflib.SequenceMatcher(None, norm[a], norm[b]).ratio()) >= 0.9}
    assert (0, 1) in want and (2, 3) in want and len(want) > 40
    for tile in (4096, 7):
        monkeypatch.setattr(D, "TITLE_TILE", tile)
        assert {(r.a, r.b): r.ratio for r in D.similar_titles(df, "id", "t").collect()} == want


def test_containing_short_and_long_spans(spark):
    spans = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "beta gamma"), (3, "not there at all in any of them"), (4, None)], "s int, span string")
    texts = spark.createDataFrame([(10, "x alpha  beta gamma\ndelta epsilon zeta eta y"), (11, "prealpha beta gamma delta epsilon zeta etapost"), (12, None)], "k int, t string")
    got = sorted(tuple(r) for r in R.containing(spans, texts, "s", "span", "k", "t").collect())
    assert got == [(1, 10), (1, 11), (2, 10), (2, 11)]


def test_slots(spark):
    s = Z.slots(spark, {"factual": 20, "definition": 20, "explanation": 20, "application": 15}, {"easy": 35, "medium": 45, "hard": 20}, ["application", "explanation", "definition", "factual"], 100)
    assert {r[0]: r[1] for r in s.groupBy("q_type").count().collect()} == {"factual": 27, "definition": 27, "explanation": 26, "application": 20}
    assert {r[0]: r[1] for r in s.groupBy("difficulty").count().collect()} == {"easy": 35, "medium": 45, "hard": 20}
    assert s.where("q_type = 'application' and difficulty <> 'hard'").count() == 0


def test_splits_do_not_leak(spark):
    rows = [(g * 10 + c, f"g{g}", "book" if g % 2 else "article", f"g{g}c{c % 3}", c % 4) for g in range(20) for c in range(10)]
    df = spark.createDataFrame(rows, "id int, g string, f string, u string, dim int")
    s = Z.make_splits(df, "g", "f", "u", "dim", least=2, most=4).cache()
    assert s.count() == 200 and {r.split for r in s.select("split").distinct().collect()} == {"train", "val", "test_indomain", "test_heldout_docs"}
    held = s.where("split = 'test_heldout_docs'").select("g").distinct()
    assert s.join(held, "g").where("split <> 'test_heldout_docs'").count() == 0
    assert [r.n_leaking for r in Z.split_checks(s, {"unit": "u"}).collect()] == [0]
    order = lambda x: sorted(map(tuple, x.select("id", "split").collect()))
    assert order(s) == order(Z.make_splits(df.repartition(7), "g", "f", "u", "dim", least=2, most=4))


def test_interleaved_prefixes(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(90)], "id int, s string")
    got = [r.s for r in Z.interleaved(df, ["s"], "id", 30).orderBy("pos").collect()]
    assert len(got) == 30 and got.count("b") == 10 and got[:4].count("b") == 2


def test_review_upsert(spark):
    old = spark.createDataFrame([("q1", "old", "accept", "fine"), ("q2", "old", " ", ""), ("gone", "x", "reject", "")], "qa_id string, question string, human_verdict string, human_notes string")
    new = spark.createDataFrame([("q1", "new"), ("q2", "new"), ("q3", "new")], "qa_id string, question string")
    got = {r.qa_id: tuple(r)[1:] for r in FS.keep_human_columns(new, old, "qa_id").collect()}
    assert got == {"q1": ("new", "accept", "fine"), "q2": ("new", "", ""), "q3": ("new", "", "")}


def test_table_text(spark):
    md, tex = FS.table_text(spark.createDataFrame([("a_b", 0.5), ("c", 0.75)], "name string, score double"), {"score": True})
    assert "| c | **0.750** |" in md and r"a\_b & 0.500" in tex and r"\textbf{0.750}" in tex


def test_tolerant_reader(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \nnot json\n{"a": 2}\n\0\0\n')
    assert sorted(r.a for r in FS.read_jsonl(spark, str(tmp_path), "a long", tolerant=True).collect()) == [1, 2]


READINGS = [84, 84, 84, 84, 80, 76, 74]


def test_hysteresis(spark, tmp_path):
    run, paused, events = 0, False, []
    for k, v in enumerate(READINGS, 1):
        run, paused, e = T.next_state(run, paused, v, 84, 75, 4)
        events += [(k, e)] * bool(e)
    assert events == [(4, "PAUSE"), (7, "RESUME")]
    df = spark.createDataFrame([("gpu", k, float(v)) for k, v in enumerate(READINGS, 1)], "device string, time int, value double")
    batch = T.alarm_history(df, "device", "time", "value", 84, 75, 4).orderBy("time").collect()
    assert [(r.time, r.state) for r in batch] == events
    src = str(tmp_path / "in")
    df.select("device", F.timestamp_seconds(F.col("time").cast("long")).alias("time"), "value").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("device string, time timestamp, value double").parquet(src)
    q = T.alarms(stream).writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.state for r in spark.table("alarms").orderBy("time").collect()] == ["PAUSE", "RESUME"]


def test_stream_takes_each_key_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    spark.createDataFrame([(1,), (2,), (2,)], "id long").write.parquet(src)
    read = lambda: spark.readStream.schema("id long").parquet(src)
    T.process_new(read(), sink, ck, ["id"])
    spark.createDataFrame([(2,), (3,)], "id long").write.mode("append").parquet(src)
    T.process_new(read(), sink, ck, ["id"])
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_windowed_spending(spark, tmp_path):
    spark.createDataFrame([(float(t), "s", "judge", "m", 1, 1, 0.5, False, None) for t in (0, 10, 3700)], T.USAGE).write.json(str(tmp_path / "u"))
    q = T.windowed_spending(T.usage_stream(spark, str(tmp_path / "u"))).writeStream.format("memory").queryName("spend").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.cost for r in spark.table("spend").collect()) == [0.5, 1.0]


def test_failed_calls_are_rows(spark):
    df = spark.createDataFrame([("good",), ("bad",)], "p string")

    def client(prompts):
        return [None if p == "bad" else p.upper() for p in prompts]

    req = M.requests(df, "p")
    got = {r.answer: r.error for r in M.call(req, client).collect()}
    assert "GOOD" in got and None in got
    assert M.resolve(req, client, rounds=2).count() == 1
    cache = M.resolve(req.where("prompt = 'good'"), client)
    assert {(r.answer, r.cached) for r in M.complete(req, cache, client).collect()} == {("GOOD", True), (None, False)}


@pytest.mark.parametrize(("e", "c", "want"), [(0.6, 0.6, (False, True)), (0.2, 0.7, (True, False)), (0.1, 0.2, (False, False))])
def test_entailment(spark, e, c, want):
    df = spark.createDataFrame([(e, c)], "e double, c double")
    assert tuple(df.select(*M.entailment(F.col("e"), F.col("c"))).first()) == want
