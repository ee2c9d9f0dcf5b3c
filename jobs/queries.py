"""The jobs as queries: each runs twice into one new folder, and the whole output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import label_release, page_intake
from labelforge.functions.text import NOISE_TAGS
from labelforge.plans.registry import HIER
from labelforge.sources.shared import new_folder

NOISE = ["home", "next", "previous"]


def job1_page_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")  # the table may be one file, which a file stream takes by a pattern only
    for _ in range(2):
        page_intake.run(spark, f"{sf_dir}/page[s].parquet", f"{folder}/out", f"{folder}/state", {"noise_tags": NOISE})
    return page_intake.current(spark, f"{folder}/out")


def job2_label_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        label_release.run(spark, sf_dir, f"{folder}/labels")
    return label_release.released(spark, f"{folder}/labels")


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
QUERIES = {f.__name__: f for f in (job1_page_intake, job2_label_release)}
SQL = {
    "job1_page_intake": rf"""
        WITH pg AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract_all(coalesce(html, ''), '(?is)<a href="[^"]*">(.*?)</a>', 1) AS a FROM pages),
        each AS (SELECT page_id, trim(regexp_replace(x, '{_SPACE}', ' ', 'g')) AS tag, pos FROM (SELECT page_id, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM pg)),
        firsts AS (SELECT page_id, arg_min(tag, pos) AS tag, min(pos) AS pos FROM each WHERE tag <> '' GROUP BY page_id, replace(lower(tag), 'ß', 'ss')),
        tg AS (SELECT page_id, string_agg(tag, ' | ' ORDER BY pos) AS tags, count(*) AS n FROM firsts WHERE replace(lower(tag), 'ß', 'ss') NOT IN ({", ".join(f"'{t}'" for t in [*NOISE_TAGS, *NOISE])}) GROUP BY 1),
        tt AS (SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '{_SPACE}', ' ', 'g')), '') AS title FROM pg)
        SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^https?://([^/:?#]+)', 1)) AS host, title, coalesce(tags, '') AS tags, coalesce(n, 0) AS n_tags, len(a) AS n_links, strlen(html) AS n_bytes,
          CASE WHEN trim(html) = '' THEN 'empty' WHEN contains(lower(html), 'enter the characters you see below') OR contains(lower(html), 'type the characters you see in this image')
            OR contains(lower(html), 'sorry, we just need to make sure you''re not a robot') THEN 'blocked' WHEN title IS NULL THEN 'untitled' ELSE 'usable' END AS status,
          coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), 'und') AS lang
        FROM pg LEFT JOIN tg USING (page_id) JOIN tt USING (page_id)""",
    "job2_label_release": f"""
        WITH {HIER} SELECT s.isbn13, s.path, s.votes, CASE WHEN can.path IS NOT NULL THEN 'canonical' WHEN reason IN ('isolated_singleton', 'singleton_extra_specificity') THEN 'review'
          WHEN reason IS NOT NULL THEN 'settled' ELSE 'pruned' END AS outcome, coalesce(reason, '') AS reason, s.field, s.isbn13 // 10000 AS block
        FROM s LEFT JOIN can USING (isbn13, field, path) LEFT JOIN rev ON rev.isbn13 = s.isbn13 AND rev.field = s.field AND rev.path = s.path""",
}
