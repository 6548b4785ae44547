"""Report documents: JSON, self-contained HTML, terminal summary."""

from __future__ import annotations

import html
import json
from pathlib import Path

SNIPPET_CHARS = 1400
STYLE = """
:root{--bg:#fff;--fg:#1b1f24;--soft:#5b6470;--line:#d8dde3;--bar:#2f6fab}
@media (prefers-color-scheme:dark){:root{--bg:#14171b;--fg:#e7eaee;--soft:#99a3ae;--line:#333a42;--bar:#6aa9e0}}
body{background:var(--bg);color:var(--fg);font:15px/1.5 system-ui,sans-serif;max-width:70rem;margin:2rem auto;padding:0 1rem}
table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid var(--line);padding:.3rem .6rem;text-align:left}
.tile{display:inline-block;margin-right:2rem}.tile b{font-size:1.6rem;display:block}.soft{color:var(--soft)}
.bar{background:var(--bar);height:.5rem}.pair{display:grid;grid-template-columns:1fr 1fr;gap:1rem}pre{overflow:auto;border:1px solid var(--line);padding:.5rem}
"""


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True) + "\n"


def removable(report: dict) -> int:
    return sum(c["removable_lines"] for c in report["clusters"])


def safe(report: dict) -> int:
    return sum(c["safely_remediable"] for c in report["clusters"])


def resolution_percent(coverage: dict) -> int:
    return round(100 * coverage["files_fully_resolved"] / coverage["files_scanned"]) if coverage["files_scanned"] else 0


def duplicated_percent(report: dict) -> float:
    lines = report["coverage"]["lines_in_units"]
    return 100 * removable(report) / lines if lines else 0.0


def compact(value: int) -> str:
    for least, by, unit in ((1_000_000, 1_000_000, "M"), (10_000, 1000, "K")):
        if value >= least:
            return f"{value / by:.1f}".removesuffix(".0") + unit
    return f"{value:,}"


def count(n: int, noun: str) -> str:
    return f"{n:,} {noun}{'' if n == 1 else 's'}"


def location(unit: dict) -> str:
    return f"{unit['path']}:{unit['start_line']}"


def snippet(root: str, unit: dict, most: int = SNIPPET_CHARS) -> str:
    """The unit's lines, clipped; empty where the file cannot be read."""
    try:
        lines = (Path(root) / unit["path"]).read_text(encoding="utf-8", errors="replace").splitlines()
    except OSError:
        return ""
    body = "\n".join(lines[unit["start_line"] - 1 : unit["end_line"]])
    return body if len(body) <= most else body[:most] + "\n…"


def to_html(report: dict, with_code: bool = True) -> str:
    """One page without outside references; everything from the repository is escaped."""
    e = lambda x: html.escape(str(x), quote=True)
    c, found = report["coverage"], report["clusters"]
    widest = max((x["removable_lines"] for x in found), default=0)
    tiles = [(compact(removable(report)), "removable lines"), (compact(len(found)), "clusters"), (compact(safe(report)), "safe to merge"), (f"{duplicated_percent(report):.1f}%", "of lines in units"), (f"{resolution_percent(c)}%", "of files resolved")]
    out = [f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Duplicate logic in {e(report['root'])}</title><style>{STYLE}</style></head><body>"]
    out.append(f"<h1>Duplicate logic</h1><p class=soft>{e(report['root'])} · {e(report['detector'])} · {e(report['generated_at'])}</p>")
    out += [f"<span class=tile><b>{e(a)}</b>{e(b)}</span>" for a, b in tiles]
    if not found:
        out.append("<p>No duplicate logic found.</p>")
    for x in found:
        width = max(4, round(100 * x["removable_lines"] / widest)) if widest else 4
        churn = "not available" if x["churn"] is None else x["churn"]
        out.append(f"<section><h2>{e(x['cluster_id'])}</h2><div class=bar style='width:{width}%'></div>")
        out.append(f"<p>{count(x['removable_lines'], 'removable line')} · {count(len(x['units']), 'copy').replace('copys', 'copies')} · {count(x['call_sites'], 'call site')} · churn {e(churn)} · score {x['score']} · {'safe' if x['safely_remediable'] else 'needs review: ' + e(', '.join(x['blocked_reasons']))}</p>")
        out.append("<ul>" + "".join(f"<li>{e(location(u))} {e(u['name'])}</li>" for u in x["units"]) + "</ul>")
        for v in x["evidence"]:
            out.append(f"<p class=soft>structural {v['structural_percent']}% ({e(v['structural_method'])}), textual {v['textual_percent']}% ({e(v['textual_method'])})</p>")
            if with_code:
                out.append("<div class=pair>" + "".join(f"<pre>{e(snippet(report['root'], v[s]))}</pre>" for s in ("left", "right")) + "</div>")
        out.append("</section>")
    cells = "".join(f"<tr><td>{e(x['cluster_id'])}<td>{len(x['units'])}<td>{x['removable_lines']}<td>{x['call_sites']}<td>{e('' if x['churn'] is None else x['churn'])}<td>{x['score']}" for x in found)
    out.append(f"<h2>Table</h2><table><tr><th>Cluster<th>Copies<th>Lines<th>Calls<th>Churn<th>Score{cells}</table>")
    holes = "".join(f"<tr><td>{e(k)}<td>{v}" for k, v in c["unresolved_by_reason"].items())
    out.append(f"<h2>Coverage</h2><p>{count(c['files_scanned'], 'file')}, {count(c['units_extracted'], 'unit')}, {count(c['candidate_pairs'], 'candidate pair')} of {c['total_possible_pairs']:,}, {c['pairs_judged']:,} judged{' (budget reached)' if c['candidates_truncated'] else ''}</p><table>{holes}</table></body></html>")
    return "".join(out)


def summary(report: dict, most: int = 5) -> str:
    c, found = report["coverage"], report["clusters"]
    out = [f"{report['root']}: {count(c['units_extracted'], 'function')} in {count(c['files_scanned'], 'file')}, {count(c['candidate_pairs'], 'candidate pair')}, {c['pairs_judged']:,} judged, {report['duration_seconds']:g} s"]
    if not found:
        return "\n".join([*out, "No duplicate logic found (structural copies only; reimplementations are not looked for).", ""])
    out.append(f"{removable(report):,} removable lines in {count(len(found), 'cluster')}, {safe(report):,} safe to merge")
    for x in found[:most]:
        out.append(f"  -{x['removable_lines']:,} lines, {len(x['units'])} copies, {x['call_sites']} calls, churn {'-' if x['churn'] is None else x['churn']} [{'safe' if x['safely_remediable'] else 'needs review'}] {location(x['units'][0])} {x['units'][0]['name']}")
    if len(found) > most:
        out.append(f"  and {len(found) - most:,} more")
    if c["candidates_truncated"]:
        out.append("The candidate budget was reached: duplication is understated. Raise --budget.")
    return "\n".join([*out, ""])


def write(path: str, content: str) -> Path:
    p = Path(path).expanduser()
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(content, encoding="utf-8")
    return p
