"""Texts cut off by field limits or in transfer, and how often each source cuts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.endings import ABBREVIATIONS, NEVER_LAST, OPEN_WORDS, open_parts, sentence_end, strip_residue
from factloom.session import cut

WHOLE, WEAK, CUT, RUNNING = 0, 1, 2, 3

_SYMBOLS = re.compile(r"^[^\w\s](?:\s*[^\w])*$")
_BRACKETED = re.compile(r"^(?:\[[^\[\]]+\]|\([^()]+\)|\{[^{}]+\}|<[^<>]+>)$")
_SIGNED = re.compile(r"^(?:[—–-]{1,2}\s?\S.*\S\s?[—–-]{1,2}|[*=~_-]{2,}\s?\S.*\S\s?[*=~_-]{2,})$")
_DATED = re.compile(r"^[^\W\d][^.!?]{0,40}[:\s]\s*(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}\.? [^\W\d]+ \d{4})(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$")
# Words of a line that closes a text.
_THE_END = re.compile(r"^(?:the end|end|fin|ende|fine|finis|end of (?:record|file|entry|document|text|article|page|message|story|transcript|section)|fin (?:del?|de la?) [^\W\d]+|ende des [^\W\d]+)$", re.I)
_PICTURE = re.compile(r"[←-⇿⌀-➿⬀-⯿\U0001f000-\U0001faff️‍]+$")
_PAGE = re.compile(r"^(?:page|seite|página|p\.)\s*\d+(?:\s*(?:of|/|von|de|sur)\s*\d+)$", re.I)


def closing_line(line: str) -> bool:
    """A line that closes a text without a full stop, and is itself complete."""
    line = line.strip()
    if not line or line.endswith(("…", "...", "[", "�")):
        return False
    return any(p.match(line) for p in (_SYMBOLS, _BRACKETED, _SIGNED, _DATED, _THE_END, _PAGE)) and not re.fullmatch(r"[-,;:&(<\[….]+", line)


def ending(text: str | None) -> int:
    """WHOLE, WEAK (no mark at the end: a title, a list), RUNNING (none after a running line) or CUT. Blank texts are whole."""
    if text is None or not (core := text.strip()):
        return WHOLE
    body, _, last = core.rpartition("\n")
    if closing_line(last):
        return WHOLE
    pictured = _PICTURE.sub("", core).rstrip()
    if pictured != core and (not pictured or sentence_end(pictured)):
        return WHOLE
    closed = re.search(r"(?<=[.!?])\s+(\S[^\n]*)$", core)
    if closed and closing_line(closed[1]):
        return WHOLE
    if sentence_end(core) and not re.search(r"(?:\.\.|…)\W*$", core):
        return WHOLE
    rest, residue = strip_residue(core)
    if residue:
        return CUT
    words = re.findall(r"[^\W\d_]+", last or core)
    if re.search(r"[.!?](?:[\s\"'”»)]|$)", core) or words and words[-1] in OPEN_WORDS or open_parts(core):
        return CUT
    if len(words) > 5 and any(w in OPEN_WORDS for w in words) or core[-1] == ".":
        return CUT
    return RUNNING if len(words) >= 5 and 2 * sum(w.islower() for w in words) > len(words) else WEAK


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, source, chars, bytes, plain, text -> the same with the ending; plain rows carry no text and are whole."""
    for batch in batches:
        endings = [WHOLE if whole else ending(t) for whole, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(endings, pa.int32())], names=["key", "source", "chars", "bytes", "ending"])


def plainly_whole(text: Column) -> Column:
    """Null and blank texts, and those that end with a mark after a plain word that is no abbreviation: most texts.

    What it says holds for ending() too; it only keeps those texts in the JVM.
    """
    tail = F.right(text, F.lit(120))
    word = F.lower(F.regexp_extract(tail, r"(?:^|\s)([\p{L}\p{N}]+)\.\s*$", 1))
    stop = (word != "") & ~word.isin(*sorted(ABBREVIATIONS | NEVER_LAST))
    return F.coalesce(stop | tail.rlike(r"[\p{L}\p{N}][!?]\s*$"), F.lit(False)) | text.isNull() | ~text.rlike(r"\S")


def _log_tail(n: Column, expected: Column) -> Column:
    """Upper bound of the log of P(X >= n) for a Poisson count (Chernoff); 0 unless n exceeds what is expected."""
    return F.when(n > expected, n - expected - n * F.log(n / expected)).otherwise(F.lit(0.0))


def significant_lengths(judged: DataFrame, reach: int = 25, rate: float = 0.01) -> DataFrame:
    """(source, unit, length, n, at_risk, hazard, near, q): lengths at which a source ends texts too often.

    For each source (a null one is a source of its own) and unit (chars, bytes), the hazard of a length is the share of
    the texts of at least this length that end there. It is tested against the pooled hazard of the lengths at most
    `reach` away, all by windows over the counts of lengths, not over rows. The tail bounds of all tests are held to a
    false discovery rate of `rate` (Benjamini-Hochberg over every length that occurs). Bounds are ranked inside classes
    of floor(log p), whose sizes give the ranks before them, so no task sorts all tests.
    """
    long = judged.where("chars > 0").select("source", F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))))
    counts = long.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    line = W.partitionBy("source", "unit").orderBy("length")
    counts = counts.withColumn("at_risk", F.sum("n").over(line.rowsBetween(W.currentRow, W.unboundedFollowing)))
    near = line.rangeBetween(-reach, reach)
    tests = counts.withColumn("ends", F.sum("n").over(near) - F.col("n")).withColumn("risks", F.sum("at_risk").over(near) - F.col("at_risk"))
    mean = F.coalesce(F.try_divide(F.col("risks"), F.count("*").over(near) - 1), F.col("at_risk"))  # of the window's lengths
    tests = tests.withColumn("near", (F.col("ends") + 0.5) / (mean * (2 * reach) + F.col("at_risk")))
    tests = tests.withColumn("log_p", _log_tail(F.col("n").cast("double"), F.col("at_risk") * F.col("near")))
    tests = cut(tests.withColumn("class", F.greatest(F.floor("log_p"), F.lit(-2000)).cast("int")))
    classes = W.orderBy("class")
    sizes = tests.groupBy("class").agg(F.count("*").alias("size"))  # at most 2,001 rows
    total = F.sum("size").over(W.partitionBy())
    sizes = sizes.select("class", (F.sum("size").over(classes) - F.col("size")).alias("before"), total.alias("tests"))
    few = tests.where(F.col("log_p") < F.log(F.lit(rate))).join(F.broadcast(sizes), "class")
    order = W.partitionBy("class").orderBy("log_p", "source", "unit", "length")
    ranked = few.withColumn("p_m", F.exp("log_p") * F.col("tests") / (F.col("before") + F.row_number().over(order)))
    later = ranked.groupBy("class").agg(F.min("p_m").alias("least"))
    later = later.select("class", F.min("least").over(classes.rowsBetween(1, W.unboundedFollowing)).alias("later"))
    kept = ranked.withColumn("own", F.min("p_m").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))).join(F.broadcast(later), "class")
    kept = kept.withColumn("q", F.least("own", "later"))
    return kept.where(F.col("q") <= rate).select("source", "unit", "length", "n", "at_risk", (F.col("n") / F.col("at_risk")).alias("hazard"), "near", "q")


class CutTexts:
    """judged: endings of all texts; limits(): significant lengths; marked(), found(): cut texts; report(): rates by source.

    A text is cut by the first rule that holds:

    * limit: its ending is incomplete in any way and its length is one at which its source ends texts too often;
    * ending: off the limits, its ending cannot be whole at any length (a broken character or tag, a comma, an open
      bracket, words after the last full stop): cuts in transfer have no common length;
    * habit: off the limits, it stops without a mark in a running line (five words or more, most of them in small
      letters), while at least the share `habit` of its source's texts end whole.
    """

    def __init__(self, df: DataFrame, key: str, text: str, source: str, reach: int = 25, rate: float = 0.01, habit: float = 0.8) -> None:
        """Keys are cast to bigint; a null source is a source of its own; other columns are not read."""
        self.settings, self.habit = (reach, rate), habit
        t = F.col("text")
        narrow = df.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
        sent = narrow.withColumn("plain", plainly_whole(t)).select("key", "source", F.coalesce(F.length(t), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("bytes"), "plain", F.when(~F.col("plain"), t).alias("text"))
        self.judged = cut(sent.mapInArrow(_judge, "key long, source string, chars long, bytes long, ending int"))

    def limits(self) -> DataFrame:
        return significant_lengths(self.judged, *self.settings)

    def marked(self) -> DataFrame:
        """judged with q (the least q-value of its length in chars or bytes, null off the limits) and rule (null: not cut)."""
        limits = self.limits().select(F.col("source").alias("s"), "unit", "length", "q")
        out = self.judged
        for unit in ("chars", "bytes"):
            mine = limits.where(F.col("unit") == unit).select("s", F.col("length").alias(f"at_{unit}"), F.col("q").alias(f"q_{unit}"))
            out = out.join(mine, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col(f"at_{unit}")), "left").drop("s", f"at_{unit}")
        whole = self.judged.where("chars > 0").groupBy(F.col("source").alias("s")).agg((F.count_if(F.col("ending") == WHOLE) / F.count("*")).alias("whole"))
        out = out.join(whole, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        q = F.least("q_chars", "q_bytes")
        rule = F.when((F.col("ending") != WHOLE) & q.isNotNull(), "limit").when(F.col("ending") == CUT, "ending").when((F.col("ending") == RUNNING) & (F.col("whole") >= self.habit), "habit")
        return out.select("key", "source", "chars", "bytes", "ending", q.alias("q"), rule.alias("rule"))

    def found(self) -> DataFrame:
        return self.marked().where("rule is not null").select("key")

    def report(self) -> DataFrame:
        """(source, texts, cut, share, at_limit, by_ending, by_habit), the last three by rule: blank and null texts are counted among the texts."""
        by = [F.count_if(F.coalesce(F.col("rule") == r, F.lit(False))).alias(name) for r, name in (("limit", "at_limit"), ("ending", "by_ending"), ("habit", "by_habit"))]
        return self.marked().groupBy("source").agg(F.count("*").alias("texts"), F.count("rule").alias("cut"), F.round(F.count("rule") / F.count("*"), 6).alias("share"), *by)
