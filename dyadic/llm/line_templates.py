"""Line dedup by a fixed-depth template tree; DataFrame functions only.

A line's tokens (split at blanks, and every character of a script that writes no
blanks is one; a token with a digit is a variable field) lead it down a tree of fixed depth: token count, then the ``LEAD`` leading tokens. In
the leaf a line belongs to its exact template and, if it is long enough, to the
``BLOCKS`` templates in which one block of the remaining tokens is a variable
field too; so two lines of a leaf share a template when they differ in one block
only. A template needs ``CONSTANT`` tokens with letters and without digits, and as
many as half of its tokens; a line with fewer is compared by its exact tokens. So
rows of numbers share no template unless they are equal. A template recurs when enough different documents hold it (short templates,
which prose repeats by chance, need more). Of a recurring template the document
with the largest id keeps its lines; the lines of the others are dropped.

Shuffles: (leaf, document) pairs with partial sums; the lines of shared leaves;
their templates with partial sums; and the documents once, by id. Hot leaves and
templates are joined against stored tables, so adaptive execution can split them.

Defined cases: a null text stays null and has no lines; lines without tokens
always stay (and those of fewer than ``min_tokens``, if it is raised); repeats inside one document count
once and stay or go together; a null id ranks below every id; rows that repeat id
and text act as one document; other columns are carried along, but for those named like
the two that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAD, BLOCKS = 3, 4
FIELD = "<*>"
#: least constant tokens of a template with variable fields
CONSTANT = 4
#: scripts that write no blanks between words, as ranges (a look-up of scripts takes several times as long): Thai and
#: Lao, Burmese, Khmer, Han with its radicals and marks, kana
UNSPACED = (r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u19e0-\u19ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
            r"\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{3ffff}]")


def _constants(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.rlike(r"^[^0-9]*?[\p{L}\p{M}][^0-9]*$")))


def _holds(constants: Column, n: Column) -> Column:
    return (constants >= CONSTANT) & (2 * constants >= n)


def plain_tokens(line: Column) -> Column:
    # one range tells most lines apart before the many of the scripts are asked
    unspaced = (F.octet_length(line) > F.length(line)) & line.rlike(r"[\u0e00-\x{10ffff}]") & line.rlike(UNSPACED)
    spaced = F.when(unspaced, F.regexp_replace(line, f"({UNSPACED})", " $1 ")).otherwise(line)
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f"))
    blanks = F.when(other, F.translate(spaced, "\t\r\f", "   ")).otherwise(spaced)
    return F.array_remove(F.split(blanks, " "), "")  # one blank is split at without a regular expression


def tokens_of(plain: Column, digits: Column) -> Column:
    return F.when(digits & _holds(_constants(plain), F.size(plain)), F.transform(
        plain, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))).otherwise(plain)


def _templates(long_tokens: int) -> Column:
    """Template hashes of a line with columns n, lead, tokens and digits: exact, then each block as a field."""
    q = F.ceil((F.col("n") - LEAD) / F.lit(BLOCKS)).cast("int")
    part = [F.slice("tokens", LEAD + 1 + i * q, F.greatest(q, F.lit(0))) for i in range(BLOCKS)]
    block = [F.xxhash64(x) for x in part]
    # a line without digits has constants enough outside of any block
    enough = [~F.col("digits") | _holds(_constants(F.col("tokens")) - _constants(x), F.col("n")) for x in part]
    variant = lambda out: F.xxhash64(F.col("lead"), F.lit(out), *[
        F.lit(0).cast("long") if i == out else block[i] for i in range(BLOCKS)])
    return F.when(F.col("n") < long_tokens, F.array(variant(-1))).otherwise(
        F.array_compact(F.array(variant(-1), *[F.when(enough[out], variant(out)) for out in range(BLOCKS)])))


def recurring_lines(docs: DataFrame, min_tokens: int = 1, long_tokens: int = 10, min_docs: int = 2,
                    short_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop: one row per document with such lines (id, row_key, dropped: 0-based line numbers)."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"),
                        F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    # a test of the line itself: one of n would tokenise it twice
    lines = lines.where(F.col("line").rlike(r"[^ \t\r\f]"))
    lines = (lines.withColumn("plain", plain_tokens(F.col("line"))).withColumn("digits", F.col("line").rlike("[0-9]"))
             .withColumn("tokens", tokens_of(F.col("plain"), F.col("digits"))).withColumn("n", F.size("tokens")))
    if min_tokens > 1:
        lines = lines.where(F.col("n") >= min_tokens)
    lines = (lines
             .withColumn("lead", F.xxhash64(F.col("n"), F.slice("tokens", 1, LEAD)))
             .select("id", "row_key", "line_no", "n", "lead", _templates(long_tokens).alias("templates")))
    lines = stored(lines, "lines")
    who = F.struct("id", "row_key")
    # leaves that two documents reach; min and max fold on the map side, so a common line is one row per task
    leaves = stored(lines.groupBy("lead").agg(F.min(who).alias("a"), F.max(who).alias("b"))
                    .where("a <> b or a.id is distinct from b.id").select("lead"), "leaves")
    held = stored(lines.join(leaves, "lead").select("id", "row_key", "line_no", "n",
                                                    F.explode("templates").alias("template")), "templates")
    # a document holds a template once, however often the line repeats in it
    shared = stored(held.groupBy("template", "n", "id", "row_key").agg(F.lit(1).alias("one"))
                    .groupBy("template", "n").agg(F.count(F.lit(1)).alias("docs"), F.max(who).alias("keeper"))
                    .where(F.col("docs") >= F.when(F.col("n") < long_tokens, short_docs).otherwise(min_docs))
                    .select("template", "keeper"), "recurring")
    return (held.join(shared, "template").where(~who.eqNullSafe(F.col("keeper")))
            .groupBy("id", "row_key").agg(F.collect_set("line_no").alias("dropped")))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The documents with their recurring lines gone, plus n_lines and n_dropped."""
    gone = recurring_lines(docs, id_col=id_col, text_col=text_col, **rules)
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["id"])
                    & (F.xxhash64(docs[id_col], docs[text_col]) == gone["row_key"]), "left")
    parts, dropped = F.split(docs[text_col], "\n", -1), gone["dropped"]
    kept = F.filter(parts, lambda line, i: ~F.array_contains(dropped, i))
    text = F.when(dropped.isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n"))
    added = ["n_lines", "n_dropped"]  # replace columns of these names
    return out.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns if c.lower() not in added],
                      F.when(docs[text_col].isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
                      F.coalesce(F.size(dropped), F.lit(0)).alias("n_dropped"))
