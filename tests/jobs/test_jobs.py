"""The jobs over copies of small tables: results, reruns, growing input, failures in between."""

import datetime as dt
import logging
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compare import duck, rows_of
from echofold.plans import job_queries  # noqa: F401 (adds the queries)
from echofold.plans.catalog import ORACLES, QUERIES
from jobs import clone_audit, commit_history

ROOT = Path(__file__).resolve().parents[2]
COMMITS = "user_id bigint, ts timestamp, extra int"


@pytest.mark.parametrize("name", ["job1_clone_audit", "job2_commit_history"])
def test_query_equals_its_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cur = duck(sf).execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def commits(r, n, first=0):
    start = dt.datetime(2024, 3, 1)
    return [(r.choice([1, 2, 3, None]), None if r.random() < 0.05 else start + dt.timedelta(hours=first + r.randrange(240)), i) for i in range(n)]


def by_day(rows):
    count, last = Counter(), {}
    for user, ts, _ in rows:
        if ts is not None:
            key = (ts.date(), None if user is None else str(user))
            count[key] += 1
            last[key] = max(ts, last.get(key, ts))
    return sorted(((*k, n, last[k]) for k, n in count.items()), key=repr)


def seen(df):
    return sorted(map(tuple, df.select("day", "path", "commits", "last_touched").collect()), key=repr)


def put(spark, rows, folder, name):
    """One more file of the input, as another writer would leave it there."""
    spark.createDataFrame(rows, COMMITS).coalesce(1).write.parquet(f"{folder}-{name}")
    Path(folder).mkdir(exist_ok=True)
    part = next(Path(f"{folder}-{name}").glob("part-*.parquet"))
    part.rename(f"{folder}/{name}.parquet")


def test_history_takes_only_what_is_new(spark, tmp_path, caplog):
    r, source, out = random.Random(1), f"{tmp_path}/in", f"{tmp_path}/out"
    one, two = commits(r, 300), commits(r, 200, first=-24) + commits(r, 50, first=600)
    put(spark, one, source, "a")
    with caplog.at_level(logging.INFO, "commit_history"):
        assert seen(commit_history.run(spark, source, out)) == by_day(one)
        untouched = {p.name for p in Path(f"{out}/history/day=2024-03-09").glob("*.parquet")}
        put(spark, two, source, "b")  # late commits of old days among them
        caplog.clear()
        assert seen(commit_history.run(spark, source, out)) == by_day(one + two)
        assert f"{out}: {len(two)} new commits" in caplog.text
        caplog.clear()
        assert seen(commit_history.run(spark, source, out)) == by_day(one + two)
        assert f"{out}: 0 new commits" in caplog.text
    days = {x[0] for x in by_day(two)}
    assert dt.date(2024, 3, 9) in days or untouched == {p.name for p in Path(f"{out}/history/day=2024-03-09").glob("*.parquet")}


def test_days_without_new_commits_are_not_rewritten(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, [(1, dt.datetime(2024, 1, 1, 5), 0), (1, dt.datetime(2024, 1, 2, 5), 0)], source, "a")
    commit_history.run(spark, source, out)
    old = {p.name for p in Path(f"{out}/history/day=2024-01-01").glob("*.parquet")}
    put(spark, [(1, dt.datetime(2024, 1, 2, 6), 0)], source, "b")
    got = seen(commit_history.run(spark, source, out))
    assert old == {p.name for p in Path(f"{out}/history/day=2024-01-01").glob("*.parquet")}
    assert got == [(dt.date(2024, 1, 1), "1", 1, dt.datetime(2024, 1, 1, 5)), (dt.date(2024, 1, 2), "1", 2, dt.datetime(2024, 1, 2, 6))]


@pytest.mark.parametrize("step", ["before", "between", "after"])
def test_a_batch_that_failed_is_taken_once(spark, tmp_path, monkeypatch, step):
    """The job dies before, between or after its two writes; the next run gives what a run without failure gives."""
    r, source, out = random.Random(2), f"{tmp_path}/in", f"{tmp_path}/out"
    one, two = commits(r, 80), commits(r, 60)
    put(spark, one, source, "a")
    commit_history.run(spark, source, out)
    put(spark, two, source, "b")
    write, done = commit_history.replace_partitions, []

    def failing(rows, path, *by):
        if step == "before" or step == "between" and done:
            raise RuntimeError("lost")
        write(rows, path, *by)
        done.append(path)
        if step == "after" and len(done) == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(commit_history, "replace_partitions", failing)
    with pytest.raises(Exception, match="lost"):
        commit_history.run(spark, source, out)
    monkeypatch.setattr(commit_history, "replace_partitions", write)
    assert seen(commit_history.run(spark, source, out)) == by_day(one + two)


def test_history_of_nothing_and_in_small_batches(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    r = random.Random(3)
    rows = [commits(r, 30) for _ in range(4)]
    put(spark, [(1, None, 0)], source, "none")
    assert seen(commit_history.run(spark, source, out)) == []
    for k, x in enumerate(rows):
        put(spark, x, source, f"f{k}")
    small = commit_history.settings() | {"files_per_batch": 1}
    assert seen(commit_history.run(spark, source, out, small)) == by_day(sum(rows, []))
    from echofold.operators import history

    table = commit_history.history(spark, out)
    since = {x["path"]: x["commits"] for x in history.churn_since(table, F.lit(dt.date(2024, 3, 5))).collect()}
    want = Counter(str(u) if u is not None else None for u, ts, _ in sum(rows, []) if ts is not None and ts.date() >= dt.date(2024, 3, 5))
    assert since == dict(want)


UNITS = "doc_id bigint, text string, lang string, source string, rank int"


def write_units(spark, tmp_path, rows):
    spark.createDataFrame([(*x, 9) for x in rows], UNITS).write.mode("overwrite").parquet(f"{tmp_path}/units")
    spark.createDataFrame([(k % 3, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), 0) for k in range(200)] + [(None, dt.datetime(2024, 6, 1), 0), (1, None, 0)], COMMITS).write.mode("overwrite").parquet(f"{tmp_path}/commits")


def test_audit_replaces_itself_and_ranks(spark, tmp_path, caplog):
    big, small = "\n".join(f"line {k} of the big one" for k in range(20)), "x = compute ( y )\nreturn x + z * w\n"
    rows = [(1, big, "en", "src0"), (2, big, "de", "src1"), (3, big + "\nmore", "en", "src0"), (4, small, "en", "src2"), (5, small, "en", None), (6, "alone in here", "en", "src9"), (7, None, "en", "src0"), (None, big, "en", "src0"), (8, "", None, "src0")]
    write_units(spark, tmp_path, rows)
    paths = [f"{tmp_path}/{x}" for x in ("units", "commits", "out")]
    with caplog.at_level(logging.INFO, "clone_audit"):
        first = clone_audit.run(spark, *paths).orderBy("rank", "id").collect()
    assert "read 8 units" in caplog.text and "wrote 5 units in 2 clusters" in caplog.text
    assert [(x["rank"], x["id"], x["keep"], x["units"], x["language"]) for x in first] == [(1, 1, True, 3, "en"), (1, 2, False, 3, "de"), (1, 3, False, 3, "en"), (2, 4, True, 2, "en"), (2, 5, False, 2, "en")]
    assert first[0]["removable_lines"] == 40 and first[0]["churn"] > 0
    assert sorted(p.name for p in Path(paths[2]).glob("language=*")) == ["language=de", "language=en"]
    assert clone_audit.run(spark, *paths).orderBy("rank", "id").collect() == first
    write_units(spark, tmp_path, rows[3:5])
    assert [x["id"] for x in clone_audit.run(spark, *paths).orderBy("id").collect()] == [4, 5]
    write_units(spark, tmp_path, rows[5:6])
    assert clone_audit.run(spark, *paths).count() == 0


def test_command_lines_run(spark, tmp_path):
    write_units(spark, tmp_path, [(1, "a b c d e f", "en", "src0"), (2, "a b c d e f", "en", "src0")])
    for args in (["clone_audit.py", "--units", f"{tmp_path}/units", "--commits", f"{tmp_path}/commits", "--out", f"{tmp_path}/o1"], ["commit_history.py", "--commits", f"{tmp_path}/commits", "--out", f"{tmp_path}/o2"]):
        done = subprocess.run([sys.executable, str(ROOT / "jobs" / args[0]), *args[1:]], capture_output=True, text=True, timeout=300, cwd=tmp_path)
        assert done.returncode == 0, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/o1").count() == 2
    assert spark.read.parquet(f"{tmp_path}/o2/history").agg(F.sum("commits")).first()[0] == 201


def test_settings_of_the_session_stay(spark, tmp_path):
    write_units(spark, tmp_path, [(1, "a b c d", "en", "src0"), (2, "a b c d", "en", "src0")])
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    clone_audit.run(spark, f"{tmp_path}/units", f"{tmp_path}/commits", f"{tmp_path}/o1")
    commit_history.run(spark, f"{tmp_path}/commits", f"{tmp_path}/o2")
    assert before == {k: spark.conf.get(k) for k in before}


def test_jobs_import_nothing_of_the_training_data_operators():
    code = "import sys; sys.path.insert(0, '.'); import jobs.clone_audit, jobs.commit_history; assert not [m for m in sys.modules if m.startswith('echofold.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
