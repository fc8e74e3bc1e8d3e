from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators import search as S
from quillspark.streaming import debounce as R

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, u, START + timedelta(milliseconds=ms), t) for i, u, ms, t in rows], "event_id long, user_id long, ts timestamp, term string")


ROWS = [(1, 1, 0, "a"), (2, 1, 299, "b"), (3, 1, 599, "c"), (4, 1, 900, "d"), (5, 2, 0, "x"), (6, 2, 0, "y"), (7, 3, 5, "z")]


def test_batch_gaps(spark):
    out = R.debounce(events(spark, ROWS))
    assert sorted(r.event_id for r in out.collect()) == [3, 4, 6, 7]
    assert sorted(r.event_id for r in R.debounce(out).collect()) == [3, 4, 6, 7]


def run(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    events(spark, ROWS).write.parquet(str(tmp_path / "in" / "1"))
    closing = events(spark, [(99, 9, 60_000, "end")])
    stream = spark.readStream.schema(closing.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closing.coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    got = run(R.debounce_stream(stream, lateness="20 seconds"), "debounced", spark)
    assert sorted(r.event_id for r in got.collect()) == [3, 4, 6, 7]


def test_latest_wins(spark, tmp_path):
    at = lambda ms: START + timedelta(milliseconds=ms)
    rows = [(1, 1, at(0), at(50)), (1, 2, at(100), at(500)), (1, 3, at(200), at(300)), (2, 4, at(0), at(10))]
    requests = spark.createDataFrame(rows, "user_id long, request_id long, issued_at timestamp, completed_at timestamp")
    assert sorted(r.request_id for r in R.latest_wins(requests).collect()) == [1, 3, 4]
    requests.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([(9, 9, at(90_000), at(90_001))], requests.schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(requests.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(R.latest_wins_stream(stream), "latest", spark)
    assert sorted(r.request_id for r in got.collect() if r.user_id != 9) == [1, 3, 4]


def test_search_stream(spark, tmp_path):
    events(spark, ROWS).select("event_id", "term").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, term string").parquet(str(tmp_path / "in"))
    seen = []
    q = R.search_stream(stream, lambda queries: queries.filter("term = 'c'"), lambda hits, n: seen.extend(r.query_id for r in hits.collect()), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert seen == [3]


def simulated(rows, cuts, lateness):
    """decide() over micro-batches, as a stream calls it for one user: (kept, late rows dropped)."""
    held, kept, late, seen, passed, before = [], [], [], 0, 0, 0
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        for r in rows[a:b]:
            if r[0] <= before:
                late.append(r)
            else:
                held.append([*r, False])
        done, held = R.decide(held, passed)
        kept += done
        seen = max([seen, *(r[0] for r in rows[a:b])])
        before, passed = passed, max(passed, seen - lateness)
    done, held = R.decide(held, 1 << 61)
    return sorted(r[1] for r in kept + done), late, held


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_decisions_are_those_of_the_batch(data):
    n = data.draw(st.integers(0, 12))
    rows = [(t := data.draw(st.integers(1, 40)), i, t + data.draw(st.integers(0, 15))) for i in range(n)]
    rows = data.draw(st.permutations(rows))
    cuts = sorted(data.draw(st.lists(st.integers(0, n), max_size=4)))
    lateness = data.draw(st.sampled_from([0, 5, 100]))
    got, late, held = simulated(rows, cuts, lateness)
    order = sorted(r for r in rows if r not in late)  # rows behind the watermark count as never sent
    assert got == sorted(r[1] for r, newer in zip(order, [*order[1:], None]) if newer is None or newer[0] > r[2])
    assert not held


def test_latest_wins_out_of_order(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [[(1, 2, at(3), at(4)), (1, 3, at(9), at(9)), (2, 8, at(5), None), (2, 7, at(4), at(4.5))], [(1, 1, at(1), at(5)), (2, 6, at(3), at(6))], [(9, 9, at(100), at(100))], [(9, 11, at(150), at(150))], [(1, 4, at(2), at(2)), (9, 10, at(200), at(200))]]
    schema = "user_id long, request_id long, issued_at timestamp, completed_at timestamp"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(R.latest_wins_stream(stream, lateness="20 seconds"), "disordered", spark)
    batch = R.latest_wins(spark.createDataFrame([r for part in rows[:2] for r in part], schema))
    want = sorted(r.request_id for r in batch.collect())
    assert want == [2, 3, 7] and sorted(r.request_id for r in got.collect() if r.user_id != 9) == want  # 4 came behind the watermark


def test_debounced_search_in_micro_batches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "en", "red fish"), (2, "en", "blue fish"), (3, "en", "blue bird")], "doc_id long, lang string, content string")
    parts = [[(1, 1, 0, "blue"), (2, 2, 0, "red")], [(3, 1, 200, "fish"), (4, 2, 5000, "bird")], [(5, 1, 90_000, "blue bird")], [(6, 9, 300_000, "")]]
    for i, part in enumerate(parts):
        events(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(events(spark, parts[0]).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    versions, seen = [], []

    def index():
        versions.append(len(versions))
        return I.build_index(docs)

    R.debounced_search_stream(stream, index, lambda hits, n: seen.extend((r.query_id, r.doc_id) for r in hits.collect()), str(tmp_path / "cp")).awaitTermination()
    kept = R.debounce(events(spark, [r for p in parts[:3] for r in p])).select(F.col("event_id").alias("query_id"), "term")
    want = [(r.query_id, r.doc_id) for r in S.search(kept, I.build_index(docs))["hits"].collect()]
    assert sorted(seen) == sorted(want) == [(2, 1), (3, 1), (3, 2), (4, 3), (5, 3)]
    assert len(versions) > 1


def test_batches_of_busy_users_equal_a_plain_version(spark):
    import random

    draw = random.Random(5)
    rows, i = [], 0
    for user in [None, *range(30)]:
        for _ in range(400 if user is None else draw.randint(1, 40)):
            i += 1
            rows.append((i, user, draw.choice([0, 59_700, 119_900, 3_600_000]) + draw.choice([0, 100, 300, 301, 600]) * draw.randint(0, 9), draw.choice([None, 0, 5, 400, 90_000, 4_000_000])))
    at = lambda ms: START + timedelta(milliseconds=ms)
    typed = spark.createDataFrame([(i, u, at(ms), str(i)) for i, u, ms, _ in rows] + [(0, 0, None, "untimed")], "event_id long, user_id long, ts timestamp, term string").repartition(5)
    requests = spark.createDataFrame([(u, i, at(ms), None if c is None else at(ms + c), "x") for i, u, ms, c in rows], "user_id long, request_id long, issued_at timestamp, completed_at timestamp, more string").repartition(5)
    stays, wins = {0: set(), 1: set(), 300: set(), 2500: set()}, set()
    for user in [None, *range(30)]:
        own = sorted((ms, i, c) for i, u, ms, c in rows if u == user)
        for (ms, i, c), later in zip(own, [x[0] for x in own[1:]] + [None]):
            for gap in stays:
                if later is None or later - ms > gap:
                    stays[gap].add(i)
            if c is not None and (later is None or later > ms + c):
                wins.add(i)
    for gap, want in stays.items():
        got = R.debounce(typed, gap).collect()
        assert {r.event_id for r in got} == want and len(got) == len(want) and all(r.term == str(r.event_id) for r in got)
    got = R.latest_wins(requests)
    assert got.columns == requests.columns and sorted(r.request_id for r in got.collect()) == sorted(wins)
    untimed = spark.createDataFrame([(1, 1, None, at(5)), (1, 2, at(3), at(4)), (2, 3, None, at(1))], "user_id long, request_id long, issued_at timestamp, completed_at timestamp")
    assert sorted(r.request_id for r in R.latest_wins(untimed).collect()) == [2, 3]
