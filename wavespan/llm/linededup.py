"""Line dedup by a tree of log templates, with DataFrame functions only.

A line's tokens that hold a digit are masked. A tree of fixed depth leads it by its number of
tokens and its leading tokens to a leaf. In a leaf the line that most documents hold stands for a
template: lines that agree with it in most positions after the leading ones belong to it, and where
they differ it is variable. What is left of the leaf forms further templates in the same way.
Templates that recur across documents, and passages that do so without any variable, are dropped
from all documents but the first that holds them.

Lines are told apart by hashes; their texts are looked at again only in leaves that hold several
lines and enough documents to matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavespan.session import stored

DEPTH = 3
#: Least share of equal positions, beyond the leading ones, of two lines of one template.
SIMILARITY = 0.6
#: Lines of a leaf, by number of texts, looked at for standing lines in each round; the last
#: number holds for all later rounds.
HEADS = (1, 1, 8, 64)
#: A template recurs if so many documents of different text hold it.
MIN_DOCS = 3
#: A line of more tokens than this that repeats as it is (masked) recurs from two documents on.
PASSAGE_TOKENS = 50
MASK = "<*>"

LINE = ["leaf", "k", "k2"]


def masked(line: Column) -> Column:
    """Tokens separated by one space, those with a digit masked."""
    odd = line.startswith(" ") | line.endswith(" ")
    for mark in ("  ", "\t", "\r", "\v", "\f"):
        odd = odd | line.contains(mark)
    line = F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(
        line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", F.lit(MASK))).otherwise(line)


def parsed(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, th (hash of the text), pos, bytes, m (masked), leaf, k, k2 and passage (whether it is
    long) for every line of ``docs``.

    ``leaf`` is 0 for lines without a literal token. It is a value rather than a filter because a
    filter would have Spark mask every line twice.
    """
    lines = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias(
            "pos", "line"))
    lines = lines.select("doc_id", "th", "pos", F.octet_length("line").cast("long").alias("bytes"),
                         masked(F.col("line")).alias("m"))
    space, nothing = F.lit(" "), F.lit("")
    literal = F.when(F.col("m").contains(MASK), F.replace(
        F.replace("m", F.lit(MASK), nothing), space, nothing)).otherwise(F.col("m")) != ""
    tokens = F.octet_length("m") - F.octet_length(F.replace("m", space, nothing)) + 1
    leaf = F.xxhash64(tokens, F.substring_index("m", " ", depth))
    return lines.select("*", F.when(literal, leaf).otherwise(0).alias("leaf"),
                        F.xxhash64("m").alias("k"), F.hash("m").alias("k2"),
                        (tokens > PASSAGE_TOKENS).alias("passage"))


def tail(line: Column, depth: int) -> Column:
    """The tokens of a line after those that led it to its leaf."""
    tokens = F.split(line, " ")
    return F.slice(tokens, F.lit(depth + 1), F.size(tokens))


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether the tails of two lines of a leaf agree in most positions."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return equal >= F.lit(similarity) * F.size(a)


def standing_lines(rest: DataFrame, similarity: float, most: int, depth: int) -> DataFrame:
    """(leaf, standing): the lines, in order, that stand for templates among the first ``most`` of
    each leaf: every line that is not like one of those before it."""
    first = Window.partitionBy("leaf").orderBy(F.col("texts").desc(), "m")
    heads = rest.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    heads = heads.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "k", tail(F.col("m"), depth).alias("tokens")))).alias("heads"))
    return heads.select("leaf", F.aggregate(
        "heads", F.slice("heads", 1, 1), lambda found, h: F.when(
            F.exists(found, lambda f: alike(h["tokens"], f["tokens"], similarity)), found).otherwise(
            F.concat(found, F.array(h)))).alias("standing"))


def leaf_templates(lines: DataFrame, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS,
                   depth: int = DEPTH) -> DataFrame:
    """(leaf, k, k2, template) for lines (leaf, k, k2, m, texts) that fall under another's or
    their own generalised template. Ties for the standing line go to the least text.

    Goes on until the lines left in a leaf could not reach ``min_docs`` together. Later rounds
    take several standing lines at once; they are those that single rounds would take.
    """
    found, rest, turn = None, lines, 0
    while True:
        heads = stored(standing_lines(rest, similarity, HEADS[min(turn, len(HEADS) - 1)], depth))
        tokens = tail(F.col("m"), depth)
        near = stored(rest.join(heads, "leaf").withColumn("template", F.get(F.filter(
            "standing", lambda h: alike(tokens, h["tokens"], similarity)), F.lit(0))["k"]).drop(
            "standing"))
        part = near.where("template is not null").select(*LINE, "template")
        found = part if found is None else found.unionByName(part)
        left = near.where("template is null").drop("template")
        still = stored(left.groupBy("leaf").agg(
            F.count("*").alias("lines"), F.sum("texts").alias("support")).where(
            (F.col("lines") > 1) & (F.col("support") >= min_docs)).select("leaf"))
        if still.isEmpty():
            return found
        rest, turn = left.join(still, "leaf"), turn + 1


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
              depth: int = DEPTH) -> DataFrame:
    """(leaf, k, k2, first_id, pair): lines of recurring templates, and passages that recur as they
    are, with the first document of the template or passage. ``pair`` marks passages that only too
    few documents for a template hold.

    ``lines`` as ``parsed``, without leaf 0. Documents of the same text count once.
    """
    by_text = lines.groupBy(*LINE, "passage", "th").agg(F.min("doc_id").alias("doc_id"))
    counted = stored(by_text.groupBy(*LINE, "passage").agg(
        F.count("*").alias("texts"), F.min("doc_id").alias("first_id")))
    open_leaves = stored(counted.groupBy("leaf").agg(
        F.count("*").alias("lines"), F.sum("texts").alias("support")).where(
        (F.col("lines") > 1) & (F.col("support") >= min_docs)).select("leaf"))
    several = lines.join(open_leaves, "leaf").select(*LINE, "m").distinct()
    templates = stored(leaf_templates(several.join(counted.drop("first_id", "passage"), LINE),
                                      similarity, min_docs, depth))
    spread = lines.join(templates, LINE).groupBy("leaf", "template", "th").agg(
        F.min("doc_id").alias("doc_id"))
    wide = spread.groupBy("leaf", "template").agg(
        F.count("*").alias("texts"), F.min("doc_id").alias("first_id")).where(
        F.col("texts") >= min_docs)
    shared = stored(templates.join(wide, ["leaf", "template"]).select(*LINE, "first_id"))
    enough = F.when(F.col("passage"), F.least(F.lit(2), F.lit(min_docs))).otherwise(F.lit(min_docs))
    alone = counted.where(F.col("texts") >= enough).join(shared, LINE, "left_anti")
    alone = alone.select(*LINE, "first_id", (F.col("texts") < min_docs).alias("pair"))
    return stored(alone.unionByName(shared.withColumn("pair", F.lit(False))))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH,
                   similarity: float = SIMILARITY) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and any others) without its recurring lines, and with
    n_lines and n_dropped before them (columns of those names are replaced).

    Lines without a token, or of masked tokens only, stay. The first document of a template, by
    least ``doc_id``, keeps its lines; rows that share that id all do, and where no row has an id,
    all. A document of which more than half would go by passages that one other document or so
    holds is a copy of it, and keeps them. A null text stays null and has 0 lines. Repeated rows
    give repeated results.
    """
    lines = stored(parsed(docs, depth)).where("leaf <> 0")
    again = recurring(lines, min_docs, similarity, depth)
    gone = lines.join(again, LINE).where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy(
        F.col("doc_id").alias("__of"), F.col("th").alias("__of_text")).agg(
        F.collect_set(F.struct("pos", "pair", "bytes")).alias("marks"))
    pairs = F.aggregate(F.filter("marks", lambda x: x["pair"]), F.lit(0).cast("long"),
                        lambda n, x: n + x["bytes"])
    gone = gone.select("__of", "__of_text", "marks", pairs.alias("__pairs"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__of"))
                       & (F.xxhash64("text") == F.col("__of_text")), "left")
    copy = F.col("__pairs") * 2 > F.octet_length("text")
    joined = joined.withColumn("__gone", F.transform(F.filter(
        "marks", lambda x: ~x["pair"] | ~copy), lambda x: x["pos"])).drop("marks", "__pairs")
    every = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n"))
    n_dropped = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).cast("long")
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns
               if c not in ("n_lines", "n_dropped")]
    return joined.select(n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), *columns)
