"""What a batch of reviewed audits must reach, and views of their findings, as SQL table functions with named parameters over stored tables.

``SELECT * FROM criteria(dev => 'd', held => 'h')``, ``SELECT * FROM shown_findings(hurts => 'both')``, ``SELECT * FROM verdict_export(site => 's')``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The bounds that were set before the runs.
CAUGHT, REDUCED, BLIND, MATCHED, STABLE, ACCEPTED, MEDIAN_S, LONGEST_S = 7, 1, 1, 0.80, 0.85, 0.90, 180, 240

OUTCOMES = "crawlens_outcomes"  # (tag, slug, check_id, outcome)
TRUTH = "crawlens_truth"  # (part, kind, slug, check_id): part dev or held
RUNS = "crawlens_runs"  # (tag, slug, wall_s, submitted, applied, valid)
FINDINGS = "crawlens_findings"  # (site_id, id, check_id, severity, status, hurts, title)
VERDICTS = "crawlens_verdicts"  # (site_id, id, verdict)

_OUTCOME = f"SELECT t.part, t.kind, coalesce(o.outcome, 'no_output') AS outcome FROM {TRUTH} t LEFT JOIN {OUTCOMES} o ON o.slug = t.slug AND o.check_id = t.check_id AND o.tag = CASE t.part WHEN 'dev' THEN {{dev}} ELSE {{held}} END"


def criteria_sql(dev: str, held: str, rep: str) -> str:
    """The criteria as SQL that DuckDB reads as well; the arguments are expressions."""
    of = lambda *kinds: f"kind IN ({', '.join(map(repr, kinds))})"
    n = lambda when: f"count(CASE WHEN {when} THEN 1 END)"
    gone, less = "outcome = 'removed'", "outcome = 'reduced'"
    match = f"({of('keep')} AND outcome = 'kept') OR ({of('reduce')} AND outcome IN ('reduced', 'removed')) OR ({of('either')} AND outcome IN ('kept', 'reduced'))"
    return f"""WITH o AS ({_OUTCOME.format(dev=dev, held=held)}),
dev AS (SELECT {n(f"{of('knowable_false')} AND outcome IN ('reduced', 'removed')")} AS caught, {n(f"{of('strict_true')} AND {gone}")} AS lost, {n(f"{of('strict_true')} AND {less}")} AS cut, {n(f"{of('unknowable')} AND {gone}")} AS blind FROM o WHERE part = 'dev'),
held AS (SELECT {n(match)} AS hit, count(*) AS n, {n(f"{of('keep', 'either')} AND {gone}")} AS lost FROM o WHERE part = 'held'),
first AS (SELECT slug, check_id, outcome, tag, max(CASE WHEN tag = {dev} THEN 1 END) OVER (PARTITION BY slug) AS has_dev, {dev} AS d FROM {OUTCOMES} WHERE tag = {dev} OR tag = {held}),
second AS (SELECT slug, check_id, outcome FROM {OUTCOMES} WHERE tag = {rep}),
again AS (SELECT count(*) AS n, {n('a.outcome = b.outcome')} AS same FROM first a JOIN (SELECT DISTINCT slug AS s FROM second) k ON a.slug = k.s LEFT JOIN second b ON b.slug = a.slug AND b.check_id = a.check_id WHERE a.tag = a.d OR a.has_dev IS NULL),
r AS (SELECT sum(submitted) AS submitted, sum(applied) AS applied, percentile_cont(0.5) WITHIN GROUP (ORDER BY wall_s) AS median_s, max(wall_s) AS longest_s, count(CASE WHEN valid THEN NULL ELSE 1 END) AS bad, count(*) AS n FROM {RUNS} WHERE tag = {dev} OR tag = {held} OR tag = {rep})
SELECT 1 AS place, 'catch' AS criterion, CAST(caught AS DOUBLE) AS reached, caught >= {CAUGHT} AS passed FROM dev
UNION ALL SELECT 2, 'keep', CAST(lost + cut AS DOUBLE), lost = 0 AND cut <= {REDUCED} FROM dev
UNION ALL SELECT 3, 'unknowable', CAST(blind AS DOUBLE), blind <= {BLIND} FROM dev
UNION ALL SELECT 4, 'held_out', CASE WHEN n > 0 THEN CAST(hit AS DOUBLE) / n END, coalesce(CAST(hit AS DOUBLE) / CASE WHEN n > 0 THEN n END >= {MATCHED} AND lost = 0, false) FROM held
UNION ALL SELECT 5, 'stability', CASE WHEN n > 0 THEN CAST(same AS DOUBLE) / n END, coalesce(CAST(same AS DOUBLE) / CASE WHEN n > 0 THEN n END >= {STABLE}, false) FROM again WHERE {rep} IS NOT NULL
UNION ALL SELECT 6, 'acceptance', CASE WHEN submitted > 0 THEN CAST(applied AS DOUBLE) / submitted END, coalesce(CAST(applied AS DOUBLE) / CASE WHEN submitted > 0 THEN submitted END >= {ACCEPTED}, false) FROM r
UNION ALL SELECT 7, 'runtime', CAST(median_s AS DOUBLE), coalesce(median_s <= {MEDIAN_S} AND longest_s <= {LONGEST_S}, false) FROM r
UNION ALL SELECT 8, 'valid', CAST(bad AS DOUBLE), bad = 0 FROM r"""


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Name the tables (``outcomes``, ``truth``, ``runs``, ``findings``, ``verdicts``) and define the functions whose tables are given."""
    names = {"outcomes": OUTCOMES, "truth": TRUTH, "runs": RUNS, "findings": FINDINGS, "verdicts": VERDICTS}
    for name, df in tables.items():
        df.createOrReplaceTempView(names[name])
    if {"outcomes", "truth", "runs"} <= set(tables):
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION criteria(dev STRING, held STRING, rep STRING DEFAULT NULL)
            RETURNS TABLE(place INT, criterion STRING, reached DOUBLE, passed BOOLEAN) RETURN {criteria_sql('criteria.dev', 'criteria.held', 'criteria.rep')}""")
    if "findings" in tables:
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION shown_findings(site STRING DEFAULT NULL, hurts STRING DEFAULT NULL, severity STRING DEFAULT NULL, status STRING DEFAULT NULL)
            RETURNS TABLE(site_id STRING, id STRING, check_id STRING, severity STRING, status STRING, hurts STRING, title STRING)
            RETURN SELECT f.site_id, f.id, f.check_id, f.severity, f.status, f.hurts, f.title FROM {FINDINGS} f
            WHERE (shown_findings.site IS NULL OR f.site_id = shown_findings.site) AND (shown_findings.hurts IS NULL OR f.hurts = shown_findings.hurts)
              AND (shown_findings.severity IS NULL OR f.severity = shown_findings.severity) AND (shown_findings.status IS NULL OR f.status = shown_findings.status)""")
    if {"findings", "verdicts"} <= set(tables):
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION verdict_export(site STRING DEFAULT NULL)
            RETURNS TABLE(site_id STRING, id STRING, check_id STRING, severity STRING, hurts STRING, title STRING, verdict STRING)
            RETURN SELECT f.site_id, f.id, f.check_id, f.severity, f.hurts, f.title, coalesce(v.verdict, 'unjudged') FROM {FINDINGS} f LEFT JOIN {VERDICTS} v ON v.site_id = f.site_id AND v.id = f.id
            WHERE verdict_export.site IS NULL OR f.site_id = verdict_export.site""")
