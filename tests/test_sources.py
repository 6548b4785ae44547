import json
import subprocess

import pytest
from pyspark.sql import functions as F

from echofold import cli
from echofold.operators import graph
from echofold.plans import report as documents
from echofold.plans.scan import scan
from echofold.sources import files as tree
from echofold.sources import units as parsing

PY = '''import os
import app.util
from .util import helper as h, other
from x import *

class Client:
    def send(self, a):
        b = h(a)
        return b

def fact(n):
    if n < 2:
        return 1
    return n * fact(n - 1)

f = lambda: 1
'''
TS = """import def, { a as b, c } from './m';
import * as ns from "./ns";
export * from './star';
const add = (x: number, y: number): number => {
  const s = x + y;
  return s;
};
class K {
  go(v) {
    add(v, 1);
    return v;
  }
}
export async function run(q) {
  const m = await import(q);
  return b(m);
}
"""


def of(rows, kind, *fields):
    return [tuple(r.get(f) for f in fields) for r in rows if r["kind"] == kind]


def test_python_units_imports_calls():
    rows = parsing.rows_of("app/a.py", "python", PY)
    assert of(rows, "unit", "name", "start_line", "end_line") == [("Client.send", 7, 9), ("fact", 11, 14)]
    assert sorted(of(rows, "import", "local_name", "source_name", "specifier")) == [("h", "helper", ".util"), ("other", "other", ".util")]
    assert of(rows, "hole", "reason", "specifier") == [("wildcard_import", "x")]
    assert sorted(of(rows, "namespace", "specifier")) == [("app.util",), ("os",)]
    assert sorted(of(rows, "call", "name", "line")) == [("fact", 14), ("h", 8)]


def test_broken_python_still_has_units():
    rows = parsing.rows_of("a.py", "python", "def f(:\n    x = 1\n    y = 2\n\nprint(")
    assert of(rows, "unit", "name", "start_line", "end_line") == [("f", 1, 3)]


def test_script_units_imports_calls():
    rows = parsing.rows_of("w/a.ts", "typescript", TS)
    assert of(rows, "unit", "name", "start_line", "end_line") == [("add", 4, 7), ("K.go", 9, 12), ("run", 14, 17)]
    assert sorted(of(rows, "import", "local_name", "source_name", "specifier")) == [("b", "a", "./m"), ("c", "c", "./m"), ("def", "default", "./m")]
    assert sorted(of(rows, "hole", "reason")) == [("dynamic_import",), ("star_reexport",)]
    assert of(rows, "namespace", "specifier") == [("./ns",)]
    assert ("add", 10) in of(rows, "call", "name", "line") and ("b", 16) in of(rows, "call", "name", "line")


@pytest.fixture
def repo(tmp_path):
    body = "def {n}(a, b):\n    total = 0\n    for x in a:\n        total += x * b\n    return total\n"
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_text(body.format(n="first") + "\n\ndef caller():\n    x = first([1], 2)\n    return x\n")
    (tmp_path / "pkg/b.py").write_text(body.format(n="second") + "\nimport os\n")
    (tmp_path / "pkg/c.py").write_text("from pkg.a import first as one\nfrom q import *\n\n\ndef use():\n    y = one([2], 3)\n    for q in [1, 2]:\n        print(q, '<script>alert(1)</script>')\n    return [y, None]\n")
    (tmp_path / "pkg/bad.py").write_bytes(b"s = '\xff'\n")
    (tmp_path / "node_modules/d.js").write_text("function z() {\n  return 1;\n}\n")
    (tmp_path / "notes.txt").write_text("def no(): pass\n")
    return tmp_path


def test_files_are_found_and_decoded(spark, repo):
    rows = {r["path"]: r["source"] for r in tree.files(spark, str(repo)).collect()}
    assert sorted(rows) == ["pkg/a.py", "pkg/b.py", "pkg/bad.py", "pkg/c.py"]
    assert rows["pkg/bad.py"] == "s = '�'\n"


def test_scan_end_to_end(spark, repo):
    found = scan(spark, str(repo), use_git=False)
    assert [c["cluster_id"] for c in found["clusters"]] == ["pkg/a.py:1:first"]
    c = found["clusters"][0]
    assert (c["removable_lines"], c["call_sites"], c["churn"], c["safely_remediable"], len(c["evidence"])) == (5, 2, None, True, 1)
    assert found["coverage"]["files_scanned"] == 4 and found["coverage"]["unresolved_by_reason"] == {"wildcard_import": 1}
    text = documents.to_json(found)
    assert text == documents.to_json(json.loads(text)) and text.endswith("}\n")
    page = documents.to_html(found | {"root": "<b>"}, with_code=False)
    assert "<b>" not in page.split("<body>")[1].split("<span")[0] and "&lt;b&gt;" in page
    assert "removable" in documents.summary(found)


def test_churn_is_null_without_git_and_counted_with(spark, repo):
    assert tree.git_log(spark, str(repo)).count() == 0
    git = ["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t"]
    for args in (["init", "-q"], ["add", "pkg"], ["commit", "-qm", "x"]):
        subprocess.run([*git, *args], check=True)
    log = tree.git_log(spark, str(repo))
    assert {r["path"]: r["commits"] for r in tree.churn(log).collect()} == {f"pkg/{x}.py": 1 for x in ("a", "b", "bad", "c")}
    assert tree.last_touched(log).where("ts is null").count() == 0


def test_exit_codes(spark, repo, tmp_path, capsys):
    assert cli.main([]) == cli.USAGE
    assert cli.main(["scan", str(repo / "nowhere")]) == cli.USAGE
    empty = tmp_path / "empty"
    empty.mkdir()
    assert cli.main(["scan", str(empty)]) == cli.NOTHING
    out = tmp_path / "deep/x.json"
    assert cli.main(["scan", str(repo), "--no-git", "--fail-on-findings", "--quiet", "--json", str(out), "--html", str(tmp_path / "x.html")]) == cli.FOUND
    assert json.loads(out.read_text())["clusters"]


def test_corpus_and_bench(spark, tmp_path, capsys):
    side = lambda t: {"kind": "inline", "name": "f", "text": t}
    rows = [
        {"pair_id": "1", "split": "train", "language": "python", "label": "duplicate", "should_consolidate": "consolidate", "left": side("def a(x): return x"), "right": side("def b(y): return y")},
        {"pair_id": "2", "split": "train", "language": "python", "label": "not_duplicate", "left": side("x = 1"), "right": side("for i in q: pass")},
        {"pair_id": "3", "split": "holdout", "language": "python", "label": "duplicate", "should_consolidate": "leave_alone", "left": side("a"), "right": side("a")},
    ]
    (tmp_path / "c.jsonl").write_text("// note\n\n" + "\n".join(map(json.dumps, rows)) + "\n")
    pairs = tree.corpus(spark, str(tmp_path), "train")
    assert sorted(r["pair_id"] for r in pairs.collect()) == ["1", "2"]
    ok = tree.corpus(spark, str(tmp_path)).withColumn("ok", tree.coherent()).orderBy("pair_id").collect()
    assert [r["ok"] for r in ok] == [True, True, False]
    gates = tmp_path / "g.toml"
    gates.write_text("[train]\nmin_precision = 0.5\nmin_recall = 0.5\n")
    assert cli.main(["bench", str(tmp_path), "--json", "--gates", str(gates)]) == cli.OK
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["tp"] == 1


def test_mine_and_repo_eval(spark, repo, tmp_path, capsys):
    assert cli.main(["mine", str(repo), "--repo", "r"]) == cli.OK
    d = tmp_path / "eval/one"
    d.mkdir(parents=True)
    (d / "findings.jsonl").write_text('{"label": true}\n{"label": null}\n{"label": false}\n')
    (d / "manifest.json").write_text('{"repo": "one", "kloc": 1.5}')
    capsys.readouterr()
    assert cli.main(["repo-eval", str(tmp_path / "eval"), "--k", "2"]) == cli.OK
    row = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (row["surfaced"], row["labelled"], row["tp"], row["precision_at_k"], row["per_kloc"]) == (3, 1, 1, 1.0, 2.0)


def test_pointer_sides_are_sliced(spark):
    pairs = spark.createDataFrame([((None, "r", "c", "p", 2, 3),)], "left struct<text:string,repo:string,commit:string,path:string,start_line:int,end_line:int>")
    fetched = spark.createDataFrame([("r", "c", "p", "a\nb\nc\nd")], "repo string, commit string, path string, source string")
    assert tree.side_text("left", fetched, pairs, "t").first()["t"] == "b\nc"


def test_paths_order_by_component(spark):
    rows = spark.createDataFrame([("a-b.py",), ("a/b.py",)], "path string").orderBy(tree.path_order(F.col("path"))).collect()
    assert [r["path"] for r in rows] == ["a/b.py", "a-b.py"]


def test_never_guess(spark):
    rows = spark.createDataFrame([("a/x.py", "..gone", "python")], "path string, specifier string, language string")
    files = spark.createDataFrame([("gone.ts",)], "path string")
    assert tuple(graph.resolve(rows, files).select("target", "reason").first()) == (None, "missing_target")


def test_scripts_with_patterns_templates_and_long_classes():
    script = "const quote = /[\"'`{]/g;\nclass A {\n  first(x) {\n    const s = x / 2 / 1;\n    return `a ${outer(`b ${inner(x)}`)} { ( `;\n  }\n  second() {\n    if (x) { third(1); }\n    return 1;\n  }\n}\nfunction last() {\n  return 1;\n}\n"
    rows = parsing.rows_of("a.js", "javascript", script)
    assert of(rows, "unit", "name", "start_line", "end_line") == [("A.first", 3, 6), ("A.second", 7, 10), ("last", 12, 14)]
    assert sorted(of(rows, "call", "name", "line")) == [("inner", 5), ("outer", 5), ("third", 8)]
    many = "class K {\n" + "".join(f"  m{i}(a) {{\n    return f{i}(a);\n  }}\n" for i in range(4000)) + "}\n"
    import time

    began = time.perf_counter()
    rows = parsing.rows_of("k.js", "javascript", many)
    assert len(of(rows, "unit", "name")) == 4000 and time.perf_counter() - began < 5


def test_files_with_odd_names_are_read_and_skipped_ones_not(spark, tmp_path):
    for name in ("app/[id].tsx", "app/a b.py", "node_modules/x/y.js", "app/{z}.js", "app/read.me"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "node_modules/x/y.js").chmod(0)
    got = sorted((r["path"], r["source"]) for r in tree.files(spark, str(tmp_path)).collect())
    assert got == [("app/[id].tsx", "x = 1\n"), ("app/a b.py", "x = 1\n"), ("app/{z}.js", "x = 1\n")]
    assert tree.files(spark, str(tmp_path / "node_modules")).count() == 1
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/x.txt").write_text("")
    assert tree.files(spark, str(tmp_path / "empty")).count() == 0


def test_scored_chunks_are_exact(spark):
    import random

    from echofold.functions import lexical

    r = random.Random(3)
    words = "if x y = 1 ( ) + for return".split()
    bases = [r.choices(words, k=r.randint(8, 60)) for _ in range(5)]
    rows = []
    for i in range(60):
        t = list(r.choice(bases))
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((f"f{i}.py", 1, " ".join(t)))
    chunks = spark.createDataFrame(rows, "path string, start_line int, text string")
    got = sorted((x["l"], x["r"], round(x["similarity"], 9)) for x in cli.scored_chunks(chunks).collect())
    sh = {f"{x['path']}:1": set(x["sh"]) for x in chunks.select("path", lexical.shingles(lexical.normalized(lexical.tokens(F.col("text"))), 3).alias("sh")).collect()}
    want = sorted((a, b, round(len(sh[a] & sh[b]) / len(sh[a] | sh[b]), 9)) for a in sh for b in sh if a < b and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.55)
    assert got == want and got
