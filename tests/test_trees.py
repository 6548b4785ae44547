"""Source trees, histories and lines, held against plain reading."""

import os
import random
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echofold.sources import files as tree
from echofold.sources import trees
from echofold.sources.trees import LogReader, TreeReader


def grown(root, seed, n=60):
    r = random.Random(seed)
    for i in range(n):
        parts = [r.choice(["a", "b", "node_modules", "src", ".git", "é x", "[z]"]) for _ in range(r.randrange(0, 5))]
        name = r.choice(["f{}.py", "f{}.PY", "f{}.ts", "f{}.d.ts", "f{}.md", ".py{}", "f{}.jsx", "node_modules{}.js"]).format(i)
        path = root.joinpath(*parts, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(f"x = {i}\n".encode() + r.choice([b"", b"\xff", "é".encode()]))
    (root / "gone.py").symlink_to(root / "nowhere")
    (root / "again").symlink_to(root, target_is_directory=True)
    (root / "dist").mkdir(exist_ok=True)
    (root / "dist.py").mkdir(exist_ok=True)
    (root / "dist.py/in.py").write_text("")


def plain(root, skipped):
    out = []
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in skipped and not Path(folder, f).is_symlink()]
        for name in names:
            path = Path(folder, name)
            if path.is_file() and trees.language_of(name):
                out.append((str(path.relative_to(root)), path.read_bytes().decode("utf-8", errors="replace"), trees.language_of(name)))
    return sorted(out)


@pytest.mark.parametrize("wanted", [1, 4, 1000])
def test_partitions_cover_the_tree_once(tmp_path, wanted):
    grown(tmp_path, wanted)
    reader = TreeReader(str(tmp_path), frozenset(tree.SKIPPED), wanted)
    got = sorted(row[:3] for p in reader.partitions() for row in reader.rows(p))
    assert got == plain(tmp_path, tree.SKIPPED) and len(got) > 10


def test_tree_is_read_by_spark(spark, tmp_path):
    grown(tmp_path, 9, 200)
    got = sorted(map(tuple, tree.files(spark, str(tmp_path)).select("path", "source", "language").collect()))
    assert got == plain(tmp_path, tree.SKIPPED)
    far = sorted(map(tuple, tree.files(spark, tmp_path.as_uri()).select("path", "source", "language").collect()))
    assert [f for f in far if not f[0].startswith("again/")] == [f for f in got if f[1]]  # Spark reads no empty files
    assert tree.listed(spark, str(tmp_path)).where("problem is not null").count() == 0
    assert [r["path"] for r in tree.listed(spark, str(tmp_path / "none")).collect()] == [""]


def test_skipped_folders_are_never_opened_and_the_driver_holds_folders_only(tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"d{k}/node_modules/deep").mkdir(parents=True)
        for j in range(25):
            (tmp_path / f"d{k}/f{j}.py").write_text("1")
            (tmp_path / f"d{k}/node_modules/deep/g{j}.js").write_text("1")
    opened, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: (opened.append(str(path)), scan(path))[1])
    reader = TreeReader(str(tmp_path), frozenset(["node_modules"]), 8)
    parts = reader.partitions()
    assert len(opened) == 1 and len(parts) <= 41  # the top only
    assert sum(1 for p in parts for _ in reader.rows(p)) == 1000
    assert not [p for p in opened if "node_modules" in p]


def test_what_cannot_be_read_is_said(tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "b.py").write_text("2")
    reader = TreeReader(str(tmp_path), frozenset(), 1)
    real = open

    def failing(path, *args):
        if str(path).endswith("b.py"):
            raise PermissionError("no")
        return real(path, *args)

    monkeypatch.setattr("builtins.open", failing)
    rows = sorted(row for p in reader.partitions() for row in reader.rows(p))
    assert rows == [("a.py", "1", "python", None), ("b.py", None, "python", "no")]


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *args, **env: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, env=os.environ | env)
    run("init", "-q")
    r = random.Random(4)
    for k in range(40):
        for name in r.sample(["a.py", "sub/b.py", "sub/é.py", "sub/deep/c d.py", "other/e.py"], 2):
            path = root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"{k}{name}")
        run("add", "-A")
        when = f"2024-01-{1 + k % 28:02d}T{k % 24:02d}:00:00+02:00"
        run("commit", "-qm", str(k), GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)
    return root


def plain_log(root):
    out = subprocess.run(["git", "-c", "core.quotepath=off", "-C", str(root), "log", "--name-only", "--no-renames", "--relative", "--pretty=format:\x01%cI %H"], check=True, capture_output=True, text=True).stdout
    rows, head = [], None
    for line in out.splitlines():
        if line.startswith("\x01"):
            head = line[1:].split(" ")
        elif line:
            rows.append((line, *head))
    return sorted(rows)


@pytest.mark.parametrize("n,folder", [(7, "."), (1, "sub"), (1000, "sub")])
def test_ranges_of_commits_give_one_log(repo, monkeypatch, n, folder):
    monkeypatch.setattr(trees, "COMMITS", n)
    reader = LogReader(str(repo / folder), "HEAD", None)
    parts = reader.partitions()
    assert len(parts) == -(-40 // n)
    assert sorted(row for p in parts for row in reader.rows(p)) == plain_log(repo / folder)


def test_history_in_spark(spark, repo, tmp_path, caplog):
    rows = plain_log(repo)
    log = tree.git_log(spark, str(repo), None)
    assert {r["path"]: r["commits"] for r in tree.churn(log).collect()} == {p: sum(x[0] == p for x in rows) for p in {x[0] for x in rows}}
    from datetime import datetime

    want = {p: max(datetime.fromisoformat(x[1]).timestamp() for x in rows if x[0] == p) for p in {x[0] for x in rows}}
    assert {r["path"]: r["t"] for r in tree.last_touched(log).select("path", F.unix_timestamp("ts").cast("double").alias("t")).collect()} == want
    assert tree.git_log(spark, str(repo), 1).count() == 0  # nothing in the last day
    assert tree.git_log(spark, str(tmp_path)).count() == 0 and "no history" in caplog.text


def test_lines_are_numbered_over_splits(spark, tmp_path):
    r = random.Random(5)
    for k in range(3):
        (tmp_path / f"f{k}.jsonl").write_text("\n".join("x" * r.randrange(0, 80) + f" {i}" for i in range(400 * k)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = tree.lines(spark, str(tmp_path), "*.jsonl").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((Path(x["file"]).name, x["line"], x["value"]) for x in rows)
    assert got == sorted((p.name, i, v) for p in tmp_path.glob("*.jsonl") for i, v in enumerate(p.read_text().split("\n"), 1) if p.stat().st_size)


def test_a_bad_line_is_named_by_its_place(spark, tmp_path):
    good = '{"pair_id": "1", "split": "train", "label": "duplicate"}'
    (tmp_path / "ok.jsonl").write_text(f"// note\n\n{good}\n")
    assert tree.corpus(spark, str(tmp_path)).count() == 1
    for bad in ("{not json", '{"pair_id": 3, "left": 5}', '{"split": "train"}'):
        (tmp_path / "bad.jsonl").write_text(f"// note\n{good}\n\n{bad}\n{good}\n")
        with pytest.raises(Exception, match=r"bad\.jsonl:4: not a labelled pair"):
            tree.corpus(spark, str(tmp_path)).select("split").collect()
