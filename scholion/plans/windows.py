"""Ordered rows: islands, carried values, latest rows, packing and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions.text import greedy_spans
from scholion.operators.merge import bumped_revision
from scholion.operators.needles import greedy_select
from scholion.operators.ordinals import carried_within, islands_within, latest, newest
from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw


@query("islands_passages", "SELECT conv_id, island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM (SELECT *, sum(CASE WHEN kind = 'h' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM turns) WHERE kind = 'v' GROUP BY ALL")
def islands_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = islands_within(bind.turns(spark, sf_dir), ["conv_id"], "turn", F.col("kind") == "h").filter("kind = 'v'")
    return found.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


@query("carry_forward_heading", "SELECT conv_id, turn, coalesce(last_value(CASE WHEN kind = 'v' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS after_turn FROM turns QUALIFY kind = 'h'")
def carry_forward_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = carried_within(bind.turns(spark, sf_dir).drop("text"), ["conv_id"], "turn", F.when(F.col("kind") == "v", F.col("turn")), "after_turn")
    return found.filter("kind = 'h'").select("conv_id", "turn", F.coalesce("after_turn", F.lit(-1)).alias("after_turn"))


@query("interleave_blocks", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind) AS position, kind, length(text) AS size FROM turns")
def interleave_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bind.turns(spark, sf_dir)
    mixed = found.filter("kind = 'v'").unionByName(found.filter("kind = 'h'"))
    return mixed.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "kind")).alias("position"), "kind", F.length("text").alias("size"))


@query("pending_heading", "SELECT conv_id, turn, heading_turn FROM (SELECT conv_id, turn, kind, last_value(CASE WHEN kind = 'h' THEN turn END IGNORE NULLS) OVER w AS heading_turn, last_value(CASE WHEN kind = 'v' THEN turn END IGNORE NULLS) OVER w AS verse_turn FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE kind = 'v' AND heading_turn > coalesce(verse_turn, -1)")
def pending_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bind.turns(spark, sf_dir).drop("text")
    for kind, name in (("h", "heading_turn"), ("v", "verse_turn")):
        found = carried_within(found, ["conv_id"], "turn", F.when(F.col("kind") == kind, F.col("turn")), name)
    return found.filter("kind = 'v' AND heading_turn > coalesce(verse_turn, -1)").select("conv_id", "turn", "heading_turn")


@query("latest_approval", "SELECT package_id, arg_max(decision, {'a': created_at, 'b': approval_id}) AS decision, max(created_at) AS created_at FROM approvals GROUP BY package_id")
def latest_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(bind.approvals(spark, sf_dir), ["package_id"], ["created_at", "approval_id"], ["decision", "created_at"])


@query("next_revision", "SELECT locale, max(revision) AS latest, 1 + max(revision) AS next FROM packages GROUP BY locale")
def next_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.packages(spark, sf_dir).groupBy("locale").agg(F.max("revision").cast("long").alias("latest"), (F.max("revision") + 1).cast("long").alias("next"))


@query("top_n_recents", "SELECT user_id, rank, seq, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rank FROM op_log) WHERE rank <= 5")
def top_n_recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(bind.op_log(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("seq")], 5).select("user_id", "rank", "seq", "k")


_WORDS = ("the", "that", "tion", "que", "los")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, spans): every place of a few overlapping needles, of any bounds, each with its needle for a key."""
    from scholion.functions.text import overlapping_positions

    each = [F.transform(overlapping_positions(F.col("text"), w), _keyed(w)) for w in _WORDS]
    return raw(spark, sf_dir, "documents").select("doc_id", F.concat(*each).alias("spans"))


def _keyed(key: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(key).alias("key"))


_SPANS = f"""needles AS (SELECT unnest({list(_WORDS)}) AS needle),
spans AS (SELECT doc_id, needle AS key, b AS start, b + length(needle) AS stop FROM (SELECT doc_id, needle, text, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(needle)) = needle)) AS b FROM documents, needles))"""


@query("overlap_adjacent", f"WITH {_SPANS} SELECT doc_id, start, stop, key, next_start FROM (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, stop, key) AS next_start FROM spans) WHERE next_start < stop")
def overlap_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that overlap, found within each document's sorted array."""
    ordered = F.array_sort("spans")
    pairs = F.filter(F.zip_with(ordered, F.slice(ordered, 2, 1 << 30), lambda a, b: F.struct(a["start"].alias("start"), a["end"].alias("stop"), a["key"].alias("key"), b["start"].alias("next_start"))), lambda x: x["next_start"] < x["stop"])
    return _spans(spark, sf_dir).select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*")


@query(
    "greedy_spans",
    f"""WITH {_SPANS},
    listed AS (SELECT doc_id, list({{'n': start - stop, 's': start, 'k': key, 'e': stop}} ORDER BY start - stop, start, key) AS l FROM spans GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x.e AND x.s < y.e)) > 0 THEN acc ELSE list_append(acc, x) END, l[:0]) AS r FROM (SELECT doc_id, list_transform(l, lambda x: x) AS l FROM listed))
    SELECT doc_id, x.s AS start, x.e AS stop, x.k AS key FROM (SELECT doc_id, unnest(r) AS x FROM folded)""",
)
def greedy_spans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.start", "x.end", "x.key")
    return greedy_select(spans, ["doc_id"]).select("doc_id", "start", F.col("end").alias("stop"), "key")


@query("revision_bump", "SELECT package_id, CASE WHEN package_id % 3 = 0 THEN revision WHEN package_id % 3 = 1 THEN revision + 1 ELSE 1 END AS revision FROM packages")
def revision_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a register that knows a third of the packages as they are, a third with other content, and a third not at all."""
    found = bind.packages(spark, sf_dir)
    register = found.filter("package_id % 3 < 2").select("package_id", F.when(F.col("package_id") % 3 == 0, F.col("digest")).otherwise("other").alias("known_digest"), F.col("revision").alias("known_revision"))
    joined = found.join(register, "package_id", "left")
    return joined.select("package_id", bumped_revision(F.col("digest"), F.col("known_digest"), F.col("known_revision")).alias("revision"))


@query("sorted_check", "SELECT o_custkey, bool_and(coalesce(o_orderdate >= before, true)) AS is_sorted FROM (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) GROUP BY o_custkey")
def sorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderdate"))), lambda x: x["o_orderdate"])
    return raw(spark, sf_dir, "orders").groupBy("o_custkey").agg(dates.alias("dates")).select("o_custkey", (F.col("dates") == F.array_sort("dates")).alias("is_sorted"))


@query(
    "job_packing",
    """WITH RECURSIVE chapters AS (SELECT lang AS refsys, source AS book, row_number() OVER (PARTITION BY lang ORDER BY source) AS pos, count(*) AS verses FROM documents GROUP BY lang, source),
    walk AS (SELECT refsys, pos, verses, 1 AS job, 1 AS chapters_in, verses AS verses_in FROM chapters WHERE pos = 1
      UNION ALL SELECT c.refsys, c.pos, c.verses, CASE WHEN w.chapters_in >= 4 OR w.verses_in + c.verses > 150 THEN w.job + 1 ELSE w.job END, CASE WHEN w.chapters_in >= 4 OR w.verses_in + c.verses > 150 THEN 1 ELSE w.chapters_in + 1 END, CASE WHEN w.chapters_in >= 4 OR w.verses_in + c.verses > 150 THEN c.verses ELSE w.verses_in + c.verses END
      FROM walk w JOIN chapters c ON c.refsys = w.refsys AND c.pos = w.pos + 1)
    SELECT refsys, CAST(job AS BIGINT) AS job, count(*) AS n_chapters, CAST(sum(verses) AS BIGINT) AS n_verses FROM walk GROUP BY refsys, job""",
)
def job_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in order into jobs of at most four chapters and 150 verses, a chapter never split: a fold over each system's few chapters."""
    counted = raw(spark, sf_dir, "documents").groupBy(F.col("lang").alias("refsys"), F.col("source").alias("book")).count()
    return pack_jobs(counted, "refsys", "book", "count").withColumnRenamed("n_rows", "n_verses")


def pack_jobs(chapters: DataFrame, key: str, order: str, size: str, most_chapters: int = 4, most_rows: int = 150) -> DataFrame:
    """(key, ``job``, ``n_chapters``, ``n_rows``): what fits goes on in a job, in order."""
    listed = chapters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("long").alias("size")))).alias("xs"))
    job = "named_struct('n_chapters', 0L, 'n_rows', 0L)"
    fold = f"""aggregate(xs, array({job}), (acc, x) ->
        IF(element_at(acc, -1).n_chapters < {most_chapters} AND (element_at(acc, -1).n_chapters = 0 OR element_at(acc, -1).n_rows + x.size <= {most_rows}),
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('n_chapters', element_at(acc, -1).n_chapters + 1L, 'n_rows', element_at(acc, -1).n_rows + x.size))),
           concat(acc, array(named_struct('n_chapters', 1L, 'n_rows', x.size)))))"""
    packed = listed.select(key, F.posexplode(F.expr(fold)).alias("job", "x"))
    return packed.select(key, (F.col("job") + 1).cast("long").alias("job"), "x.*")
