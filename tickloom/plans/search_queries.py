"""Full-text queries, answered from a maintained index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import new_folder
from ..operators.fulltext import Index
from ..sources import articles as src
from .text_queries import ART

QUERIES, ORACLES = {}, {}
_folders: dict[tuple[str, str], str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.articles(src.table(spark, sf_dir, "documents"))


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """The index over all articles, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        index = Index(spark, new_folder(spark, "fulltext"))
        index.add(_articles(spark, sf_dir).select("id", F.col("body").alias("text")), 0)
        _folders[key] = index.folder
    return Index(spark, _folders[key])


@query(f"WITH {ART} SELECT id FROM art WHERE len(list_intersect(regexp_split_to_array(lower(coalesce(body, '')), '[^\\p{{L}}\\p{{N}}]+'), ['anea', 'keit', 'que'])) > 0")
def fulltext_or(spark, sf_dir):
    """Articles with any of the tokens."""
    return _index(spark, sf_dir).search(["anea", "keit", "que"], every=False)


@query(f"WITH {ART} SELECT id FROM art WHERE list_has_all(regexp_split_to_array(lower(coalesce(body, '')), '[^\\p{{L}}\\p{{N}}]+'), ['anea', 'the'])")
def fulltext_and(spark, sf_dir):
    """Articles with all of the tokens."""
    return _index(spark, sf_dir).search(["anea", "the"], every=True)


@query(f"""WITH {ART} SELECT id, title, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS at FROM art WHERE len(list_intersect(regexp_split_to_array(lower(coalesce(body, '')), '[^\\p{{L}}\\p{{N}}]+'), ['anea', 'keit'])) > 0 ORDER BY fetched_at DESC, id DESC LIMIT 10""")
def fulltext_newest(spark, sf_dir):
    """The ten newest articles with any of the tokens."""
    a = _articles(spark, sf_dir).join(_index(spark, sf_dir).search(["anea", "keit"], every=False), "id", "left_semi")
    return a.orderBy(F.col("fetched_at").desc(), F.col("id").desc()).limit(10).select("id", "title", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


TOKENS = """t AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(body, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM docs),
    c AS (SELECT id, len(ts) AS n, word, len(list_filter(ts, lambda x: x = word)) AS tf FROM t, (SELECT unnest(['anea', 'keit', 'the']) AS word)),
    w AS (SELECT word, ln(1 + ((SELECT count(*) FROM t) - count(*) FILTER (tf > 0) + 0.5) / (count(*) FILTER (tf > 0) + 0.5)) AS weight FROM c GROUP BY word),
    s AS (SELECT id, sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(len(ts)) FROM t)))) AS score FROM c JOIN w USING (word) WHERE tf > 0 GROUP BY id)"""


@query(f"WITH {ART}, docs AS (SELECT id, body FROM art), {TOKENS} SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 25")
def fulltext_ranked(spark, sf_dir):
    """The 25 best articles for three tokens by BM25."""
    return _index(spark, sf_dir).ranked(["anea", "keit", "the"], 25).withColumn("score", F.round("score", 6))


CHANGED = """docs AS (SELECT id, CASE WHEN id % 7 = 0 THEN title ELSE body END AS body FROM art WHERE id % 11 <> 0)"""


@query(f"WITH {ART}, {CHANGED}, {TOKENS} SELECT 'index' AS state, id, CAST(sum(tf) AS BIGINT) AS hits FROM c GROUP BY id HAVING sum(tf) > 0 UNION ALL SELECT 'merged', id, CAST(sum(tf) AS BIGINT) FROM c GROUP BY id HAVING sum(tf) > 0")
def fulltext_maintained(spark, sf_dir):
    """An index that took articles in three parts, then other texts for every seventh, and lost every eleventh; as it is, and merged."""
    art, index = _articles(spark, sf_dir).select("id", "title", F.col("body").alias("text")), Index(spark, new_folder(spark, "maintained"))
    for part in range(3):
        index.add(art.where(F.col("id") % 3 == part), part)
    index.add(art.where("id % 7 = 0").select("id", F.col("title").alias("text")), 3)
    index.add(art.where("id % 7 = 0").select("id", F.col("title").alias("text")), 3)
    index.remove(art.where("id % 11 = 0"), 4)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("hits")
    states = {"index": index, "merged": index.merged(new_folder(spark, "maintained"))}
    each = [i.matches(["anea", "keit", "the"]).select(F.lit(name).alias("state"), "id", total) for name, i in states.items()]
    return each[0].unionByName(each[1])
