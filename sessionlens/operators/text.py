"""Text quality: segment windows, keyword spans, citations, word error rate, digits, tags."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW_SEGMENTS, WINDOW_OVERLAP, SUMMARY_WORDS = 40, 5, 120

#: The phrases that mark a kind of statement (case-insensitive).
KEYWORDS = {
    "bias_statement": r"\b(bias|richtung|long|short|bullish|bearish)\b",
    "rule_mention": r"\b(playbook|setup|skalp|scalp|swing)\b",
    "stop_target": r"\b(stop|ziel|target|invalid)\b",
    "hourly_checkin": r"\b(check-?in|check in|stundencheck)\b",
    "tilt": r"\b(tilt|tilted|rache|revenge)\b",
    "brief_ref": r"\b(brief|briefing)\b",
    "grok_ref": r"\bgrok\b",
}


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode canonical composition."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def casefold_nfc(s: pd.Series) -> pd.Series:
    """Composition, then case folding (a sharp s becomes ss)."""
    return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def plain_words(text: Column) -> Column:
    """Words of a text in lower case without punctuation, for text without combining marks or sharp s."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


def normalize_german(text: Column, fold_umlauts: bool = False) -> Column:
    """Composition, case folding, punctuation to blanks; umlauts as two letters if wanted."""
    if fold_umlauts:
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue")):
            text = F.replace(nfc(text) if a == "ä" else text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(casefold_nfc(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def contains_token(plain: Column, token: Column) -> Column:
    """Whether a text of words with single blanks holds the token's words in a row, whole."""
    return F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.concat(F.lit(" "), token, F.lit(" ")))


def keyword_spans(segments: DataFrame, keywords: Mapping[str, str] = KEYWORDS) -> DataFrame:
    """session_id, seg, t0_us, kind: the kinds whose phrase a segment holds; one pass over the text."""
    kinds = F.filter(F.array(*(F.when(F.col("text").rlike(f"(?iU){p}"), F.lit(k)) for k, p in keywords.items())), lambda k: k.isNotNull())
    return segments.select("session_id", "seg", "t0_us", F.explode(kinds).alias("kind"))


def segment_windows(segments: DataFrame, size: int = WINDOW_SEGMENTS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """session_id, window, seg: segments in windows of ``size`` that overlap; the first window that reaches the end is the last."""
    step = max(size - max(overlap, 0), 1)
    w = Window.partitionBy("session_id")
    placed = segments.select("session_id", "seg", (F.row_number().over(w.orderBy("turn")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    # Window k holds [k * step, k * step + size); windows start before the first one that reaches n.
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step))
    high = F.least(last, F.floor(F.col("i") / step))
    return placed.where(low <= high).select("session_id", "seg", F.explode(F.sequence(low, high)).alias("window"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """One span for each (session_id, field, seg): the longest quote, then the smallest text; sorted use is by seg."""
    best = F.min_by(F.struct("text", "t_us"), F.struct(-F.length("text"), F.col("text"), F.col("t_us")))
    return spans.groupBy("session_id", "field", "seg").agg(best.alias("b")).select("session_id", "field", "seg", "b.text", "b.t_us")


def first_events(events: DataFrame) -> DataFrame:
    """Events without repeats of (session_id, kind, seg): the earliest by (t_us, seg, kind)."""
    others = sorted({*events.columns} - {"session_id", "kind", "seg", "t_us"})
    w = Window.partitionBy("session_id", "kind", "seg").orderBy("t_us", *others)
    return events.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_by_field(spans: DataFrame) -> DataFrame:
    """session_id, kind, seg: the earliest segment of each kind."""
    return spans.groupBy("session_id", "kind").agg(F.min_by("seg", F.struct("t0_us", "seg")).alias("seg"))


def check_citations(spans: DataFrame, segments: DataFrame, normalise: bool = True) -> DataFrame:
    """spans with ok: the segment exists, holds the quote word for word (a null or empty one always), and the token, if there is one, as it is or as whole words in any case.

    spans: session_id, seg, quote, token. Segments may have raw_text, which is searched too. Both sides are composed (NFC) first, unless the caller knows they are.
    """
    form = nfc if normalise else (lambda c: c)
    raw = F.col("raw_text") if "raw_text" in segments.columns else F.lit(None).cast("string")
    texts = segments.select("session_id", "seg", form(F.concat_ws("\n", F.coalesce("text", F.lit("")), raw)).alias("__text"))
    j = spans.join(texts, ["session_id", "seg"], "left")
    token = form(F.col("token"))
    whole = contains_token(F.array_join(plain_words(F.col("__text")), " "), F.array_join(plain_words(token), " "))
    token_ok = F.col("token").isNull() | F.coalesce(F.contains("__text", token) | whole, F.lit(False))
    quote_ok = F.contains("__text", form(F.coalesce("quote", F.lit(""))))
    return j.withColumn("ok", F.coalesce(quote_ok, F.lit(False)) & token_ok).drop("__text")


def guard(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans that hold, and one gap for each that doesn't."""
    gap = F.concat_ws(":", F.lit("citation dropped"), "seg")
    return checked.where("ok").drop("ok"), checked.where("not ok").select("session_id", gap.alias("gap")).distinct()


def digit_runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)))


def digit_audit(drafts: DataFrame, allowed: DataFrame) -> DataFrame:
    """draft_id, unknown: digit runs of a draft that none of its session's facts hold; drafts without any are left out.

    drafts: draft_id, session_id, text; allowed: session_id, run.
    """
    runs = drafts.select("draft_id", "session_id", F.explode(digit_runs(F.col("text"))).alias("run"))
    bad = runs.join(allowed.select("session_id", "run").distinct(), ["session_id", "run"], "left_anti")
    return bad.groupBy("draft_id").agg(F.array_join(F.array_sort(F.collect_set("run")), ",").alias("unknown"))


def word_errors(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs with n_words, edits and wer. ref and hyp are arrays of words.

    Each word of a pair becomes one code point, surrogates aside, so Spark's own levenshtein counts word edits: over a
    million distinct words in a pair. An empty reference has rate 0 against nothing and 1 against anything.
    """
    words = F.array_distinct(F.concat(ref, hyp))

    def coded(c: str) -> Column:
        def code(x: Column) -> Column:
            at = F.array_position(F.col("__w"), x) + 255
            return F.decode(F.unhex(F.lpad(F.hex((at + F.when(at >= 0xD800, 0x800).otherwise(0)).cast("long")), 8, "0")), "UTF-32")

        return F.array_join(F.transform(c, code), "")

    out = pairs.withColumn("__w", words).withColumns({"n_words": F.size(ref).cast("long"), "edits": F.levenshtein(coded(ref), coded(hyp)).cast("long")}).drop("__w")
    empty = F.when(F.col("edits") == 0, 0.0).otherwise(1.0)
    return out.withColumn("wer", F.when(F.col("n_words") == 0, empty).otherwise(F.col("edits") / F.col("n_words")))


def jargon_recall(pairs: DataFrame, tokens: Sequence[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs with n_jargon and recall: tokens, of one or more words, of the reference that the hypothesis has too; 1.0 without any."""
    known = F.array(*(F.lit(t) for t in tokens))

    def held(candidates: Column, words: str) -> Column:
        return F.filter(candidates, lambda t: contains_token(F.array_join(words, " "), t))

    there = held(known, ref)
    both = F.size(held(there, hyp))
    return pairs.withColumns({"n_jargon": F.size(there).cast("long"), "recall": F.when(F.size(there) == 0, 1.0).otherwise(both / F.size(there))})


def run_compare(a: DataFrame, b: DataFrame, tolerance_us: int = 20_000) -> DataFrame:
    """session_id, same: both transcripts have the same segments, texts, and times within the tolerance."""
    x, y = a.select("session_id", "seg", "text", "t0_us"), b.select("session_id", "seg", F.col("text").alias("b_text"), F.col("t0_us").alias("b_us"))
    equal = F.col("text").eqNullSafe(F.col("b_text")) & (F.abs(F.col("t0_us") - F.col("b_us")) <= tolerance_us)
    return x.join(y, ["session_id", "seg"], "full").groupBy("session_id").agg(F.bool_and(F.coalesce(equal, F.lit(False))).alias("same"))


def tag_hits(texts: DataFrame, tags: Sequence[str], column: str = "text") -> DataFrame:
    """id, tag, n: leftmost-longest whole-word hits of a closed vocabulary; '_' counts as a word character."""
    alternatives = "|".join(F_quote(t) for t in sorted(tags, key=lambda t: (-len(t), t)))
    hits = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(rf"(?U)(?<!\w)({alternatives})(?!\w)"), F.lit(1))
    return texts.select("id", F.explode(hits).alias("tag")).groupBy("id", "tag").agg(F.count("*").alias("n"))


def F_quote(literal: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c for c in literal)


def first_sentence(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+")[0]


def labelled_values(lines: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """page_id, label, value: the first 'Label: value' line of each known label. lines: page_id, line_no, line."""
    parts = lines.select("page_id", "line_no", F.regexp_extract("line", r"^\s*([^:]{1,40}?)\s*:\s*(\S.*?)\s*$", 1).alias("raw"), F.regexp_extract("line", r"^\s*([^:]{1,40}?)\s*:\s*(\S.*?)\s*$", 2).alias("value"))
    label = F.lit(None).cast("string")
    for alias, name in aliases.items():
        label = F.when(F.lower("raw") == alias.lower(), F.lit(name)).otherwise(label)
    named = parts.withColumn("label", label).where("label is not null and value <> ''")
    return named.groupBy("page_id", "label").agg(F.min_by("value", "line_no").alias("value"))


def stated_agrees(stated: Column, lab: Column, alignment: Column) -> Column:
    """True, false or null (unverifiable): equal after normalisation, else a shared whole token, else 'all_aligned'."""
    token = F.lit(r"[\p{L}\p{N}_]+")

    def tokens(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), token, F.lit(0))

    s, lb = tokens(stated), tokens(lab)
    both = (F.size(s) > 0) & (F.size(lb) > 0)
    equal = F.array_join(s, "") == F.array_join(lb, "")
    return F.when(both, equal | F.arrays_overlap(s, lb)).when(F.lower(F.trim(F.coalesce(alignment, F.lit("")))) == "all_aligned", F.lit(True))
