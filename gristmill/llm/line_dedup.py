"""Line dedup by a log-template tree, in DataFrame functions only.

A line's leaf is its number of tokens and its first `depth` tokens, with tokens that hold a digit masked as variable fields. A leaf holds a list
of templates: a line joins a template if it agrees with the template's leading line at `agree` of all positions; where it doesn't, the template has a
variable field. Leaders are found without comparing all lines of a leaf: the positions beyond the first `depth` are cut into one segment more than
a line may disagree in, so a line and its leader have a whole segment in common. Lines that share a segment propose as leader the one among them whose
segments are the most common; who agrees with a leader joins it, and the rest goes on without them until nobody joins any more.
A template that stands in `min_docs` different texts or more is recurring: its lines are dropped, save in the text of
the smallest doc_id that has it, so that no content is lost altogether.

Leaves and lines travel as hashes; the texts are written once, bucketed by a number of their row, and each decision is joined to them
there. Texts are read for the templates only where a leaf has several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import bucketed
from gristmill.session import staged

FIELD = "<*>"


def spaced(line: Column) -> Column:
    """Tokens joined by single spaces. Most lines are so already, which plain searches tell sooner than an expression does."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.btrim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line), F.lit(" "))


def fielded(line: Column) -> Column:
    """Tokens that hold a digit as FIELD; line: spaced."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(line)


def with_masked(df: DataFrame, line: Column, *keep: str) -> DataFrame:
    """keep and _m, the line with its fields masked. A generator for each step: what it makes is worked out once, however often it is used."""
    held = df.select(*keep, F.explode(F.array(spaced(line))).alias("_s"))
    return held.select(*keep, F.explode(F.array(fielded(F.col("_s")))).alias("_m"))


def n_tokens(m: Column) -> Column:
    """Of a masked line that isn't empty."""
    return F.octet_length(m) - F.octet_length(F.replace(m, F.lit(" "), F.lit(""))) + 1


def joined_templates(kinds: DataFrame, depth: int, agree: float) -> DataFrame:
    """_own and _template of each line that joins another one's template; kinds: _leaf, _own, _tokens, a row for each different line.

    Nothing is gathered by segment or leader: leaders are grouped maxima that come back by joins, whose skew Spark may split.
    Each round settles all leaders that follow no other one and those who join them, so rounds end.
    """
    tokens, n = F.col("_tokens"), F.size("_tokens")
    apart = F.floor(n * (1 - agree) + 1e-9).cast("int")
    edge = lambda j: F.lit(depth) + F.floor(j * (n - depth) / (apart + 1)).cast("int")
    keys = F.transform(F.sequence(F.lit(0), apart), lambda j: F.xxhash64("_leaf", j, F.slice(tokens, edge(j) + 1, edge(j + 1) - edge(j))))
    live, found = kinds.where(n > depth).select("_own", F.explode(keys).alias("_key")), kinds.select("_own", F.col("_own").alias("_template")).limit(0)
    same = F.aggregate(F.zip_with("_tokens", "_other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, v: a + v)
    while True:
        live = staged(live, "segments")
        met = staged(live.join(live.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1"), "_key"), "met")
        met = staged(met.join(met.groupBy("_own").agg(F.sum("_n").alias("_s")), "_own").select("_own", "_key", "_s"), "met")
        leaders = met.groupBy("_key").agg(F.max(F.struct("_s", "_own")).alias("_y"))
        pairs = met.join(leaders, "_key").where(F.col("_own") != F.col("_y._own")).select("_own", "_y").distinct()
        pairs = pairs.join(kinds.select("_own", "_tokens"), "_own").join(kinds.select(F.col("_own").alias("_o"), F.col("_tokens").alias("_other")), F.col("_y._own") == F.col("_o"))
        agreed = staged(pairs.where((n == F.size("_other")) & (same >= agree * n - 1e-9)).select("_own", "_y"), "agreed")
        if agreed.isEmpty():
            return found
        follows = agreed.select(F.col("_own").alias("_o")).distinct()
        joined = staged(agreed.join(follows, F.col("_y._own") == F.col("_o"), "left_anti").groupBy("_own").agg(F.max("_y")["_own"].alias("_template")), "joined")
        found = found.unionByName(joined)
        live = met.select("_own", "_key").join(joined.select("_own").union(joined.select("_template")).distinct(), "_own", "left_anti")


def drop_recurring_lines(df: DataFrame, depth: int = 4, agree: float = 0.8, min_docs: int = 5, min_tokens: int = 3, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """df with the lines of recurring templates dropped from text; counts adds n_lines and n_dropped.

    Lines of fewer than min_tokens tokens, empty ones included, always stay. Copies of a text count as one document and all lose the same lines; null keys come after
    all others. A null text stays null (no lines), an empty one is one empty line, and a text whose lines all go becomes empty.
    Of lines whose segments are equally common the one with the greater digest leads. An empty table stays empty; other columns pass through, whatever their names.
    """
    cols = df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    # rows are dealt out by a number of their own, so that copies of a text don't gather
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.unhex(F.md5(F.encode(body, "UTF-8"))).alias("_ld_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    held = bucketed(rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_row"), "_row", "texts")  # a file for each bucket
    doc, body = F.col(f"_c{cols.index(key)}"), F.col(f"_c{cols.index(text)}")

    m, place_of = F.col("_m"), ["_row", "_ld_text", "_doc", "_line"]
    lines = held.where(body.isNotNull()).select("_row", "_ld_text", F.coalesce(doc.cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), F.posexplode(F.split(body, "\n")).alias("_line", "_x"))
    long_enough = (m != "") & (F.substring_index(m, " ", min_tokens - 1) != m if min_tokens > 1 else F.lit(True))
    lines = with_masked(lines, F.col("_x"), *place_of).where(long_enough).select(*place_of, F.xxhash64(n_tokens(m), F.substring_index(m, " ", depth)).alias("_leaf"), F.unhex(F.md5(m)).alias("_own"))
    lines = staged(lines, "lines")

    # only leaves that stand in several texts can hold a recurring template
    leaves = lines.groupBy("_leaf").agg(F.count("*").alias("_n"), F.min("_ld_text").alias("_a"), F.max("_ld_text").alias("_b"), F.min("_own").alias("_p"), F.max("_own").alias("_q"))
    leaves = staged(leaves.where((F.col("_n") >= min_docs) & (F.col("_a") != F.col("_b"))).select("_leaf", (F.col("_p") != F.col("_q")).alias("_several")), "leaves")
    lines = staged(lines.join(leaves, "_leaf"), "lines")

    # the different lines of leaves that have several, each read where it stands first
    kinds = lines.where("_several").groupBy("_leaf", "_own").agg(F.min(F.struct("_row", "_line")).alias("_at"))
    wanted = kinds.select("_at._row", F.struct("_at._line", "_leaf", "_own").alias("_w")).groupBy("_row").agg(F.collect_list("_w").alias("_w"))
    texts = held.select("_row", body.alias("_x")).join(wanted.hint("merge"), "_row").select(F.split("_x", "\n").alias("_x"), F.explode("_w").alias("_w")).select("_w._leaf", "_w._own", F.element_at("_x", F.col("_w._line") + 1).alias("_x"))
    kinds = staged(with_masked(texts, F.col("_x"), "_leaf", "_own").select("_leaf", "_own", F.split("_m", " ").alias("_tokens")), "kinds")
    joined = joined_templates(kinds, depth, agree)

    told = lines.where("_several").join(joined, "_own", "left").select(*place_of, F.coalesce("_template", "_own").alias("_template"))
    told = staged(told.unionByName(lines.where("not _several").select(*place_of, F.col("_own").alias("_template"))), "templates")
    texts_of = told.groupBy("_template", "_ld_text").agg(F.min("_doc").alias("_doc"))
    recurring = texts_of.groupBy("_template").agg(F.count("*").alias("_n"), F.min(F.struct("_doc", "_ld_text")).alias("_first")).where(F.col("_n") >= min_docs).select("_template", F.col("_first._ld_text").alias("_keeper"))
    dropped = told.join(staged(recurring, "recurring"), "_template").where(F.col("_ld_text") != F.col("_keeper")).groupBy("_row").agg(F.array_sort(F.collect_set("_line")).alias("_drop"))

    # what stays lies between the dropped lines
    out = held.join(dropped.hint("merge"), "_row", "left").withColumn("_x", F.split(body, "\n"))
    edges = F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size("_x")))
    kept = F.expr("flatten(transform(sequence(1, size(_e) - 1), j -> slice(_x, _e[j - 1] + 2, _e[j] - _e[j - 1] - 1)))")
    out = out.withColumn("_e", F.when(F.col("_drop").isNotNull(), edges)).withColumn("_text", F.when(F.col("_drop").isNull(), body).otherwise(F.array_join(kept, "\n")))
    more = [F.coalesce(F.when(body.isNotNull(), F.size("_x")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("_drop").isNotNull(), F.size("_drop")), F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*[(F.col("_text") if c == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(cols)], *more * counts)
