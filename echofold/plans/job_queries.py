"""The jobs as queries: each runs twice into a folder of its own, which it leaves, and returns what stands there."""

from __future__ import annotations

import uuid

from ..runtime import shared_dir
from .catalog import query
from .registry import CLUSTERS


def own_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/echofold/{name}-{uuid.uuid4().hex}"


@query(CLUSTERS + """,
    churned AS (SELECT 'src' || (user_id % 25) AS path, count(*) AS commits FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAY AND user_id IS NOT NULL GROUP BY 1),
    p AS (SELECT DISTINCT cluster_id, path FROM member),
    churn_of AS (SELECT cluster_id, CAST(coalesce(sum(commits), 0) AS BIGINT) AS churn FROM p LEFT JOIN churned USING (path) GROUP BY 1),
    scored AS (SELECT cluster_id, units, removable_lines, churn, round(removable_lines * (1 + ln(1 + churn::DOUBLE)), 4) AS score FROM size_of JOIN churn_of USING (cluster_id)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, cluster_id) AS rank FROM scored)
    SELECT rank, cluster_id, m.doc_id AS id, m.path, m.name, CAST(m.lines AS BIGINT) AS lines, m.doc_id = m.component AS keep, units, removable_lines, churn, score, d.lang AS language
    FROM member m JOIN ranked USING (cluster_id) JOIN documents d ON d.doc_id = m.doc_id""")
def job1_clone_audit(spark, sf_dir):
    from jobs import clone_audit

    out = own_folder(spark, "clone-audit")
    for _ in range(2):
        written = clone_audit.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/events.parquet", out)
    return written


@query("SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS path, count(*) AS commits, max(ts) AS last_touched FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def job2_commit_history(spark, sf_dir):
    from jobs import commit_history

    out = own_folder(spark, "commit-history")
    for _ in range(2):
        # A file stream takes a folder or a pattern, and the table may be one file.
        written = commit_history.run(spark, f"{sf_dir}/event[s].parquet", out)
    return written
