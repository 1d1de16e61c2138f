"""Equality joins with fallbacks, priorities and carried-over state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recon_status(trades: DataFrame, recon: DataFrame) -> DataFrame:
    """trades with recon_status: by (session_date, instrument), else by the whole day (instrument '')."""
    exact = recon.where("instrument <> ''").select("session_date", "instrument", F.col("status").alias("__exact"))
    day = recon.where("instrument = ''").select("session_date", F.col("status").alias("__day"))
    j = trades.join(exact, ["session_date", "instrument"], "left").join(day, "session_date", "left")
    return j.withColumn("recon_status", F.coalesce("__exact", "__day")).drop("__exact", "__day")


def recon_conflicts(recon: DataFrame) -> DataFrame:
    """Keys with more than one status."""
    return recon.groupBy("session_date", "instrument").agg(F.count_distinct("status").alias("n")).where("n > 1")


def lot_positions(lots: DataFrame, trades: DataFrame) -> DataFrame:
    """trades with position_id: the position that lists the trade; the last listing (by position_id) wins."""
    listed = lots.select("position_id", F.explode("trade_ids").alias("trade_id")).groupBy("trade_id").agg(F.max("position_id").alias("__new"))
    j = trades.join(listed, "trade_id", "left")
    return j.withColumn("position_id", F.coalesce("__new", "position_id")).drop("__new")


def account_of(trade_id: Column) -> Column:
    return F.nullif(F.regexp_extract(trade_id, "^tx:([^:]+):", 1), F.lit(""))


def account_check(trades: DataFrame, journal: str = "journal") -> DataFrame:
    """journal, account, problem: the one account of a journal's trade ids; several, or none, are a problem."""
    acc = trades.groupBy(journal).agg(F.count_distinct("account").alias("n"), F.min("account").alias("a"))
    return acc.select(journal, F.when(F.col("n") == 1, F.col("a")).alias("account"), F.when(F.col("n") == 0, "no account").when(F.col("n") > 1, "several accounts").alias("problem"))


def lab_join(trades: DataFrame, lab: DataFrame) -> DataFrame:
    """trades with tier and lab_row: the first lab row, in file order, of the best tier.

    1 its fill is the entry fill; 2 its trade id is the entry fill; 3 its fill is the trade id; 4 its trade id is the trade id, unless its fill is another's.
    """
    rows = lab.select("row_no", F.col("entry_fill_id").alias("l_fill"), F.col("trade_id").alias("l_trade"))
    t = trades.select("trade_id", "entry_fill_id")

    def tier(n: int, on: Column) -> DataFrame:
        return t.join(rows, on).select("trade_id", F.lit(n).alias("tier"), "row_no")

    every = tier(1, F.col("entry_fill_id") == F.col("l_fill")).unionByName(tier(2, F.col("entry_fill_id") == F.col("l_trade"))).unionByName(tier(3, F.col("trade_id") == F.col("l_fill")))
    every = every.unionByName(tier(4, (F.col("trade_id") == F.col("l_trade")) & (F.col("l_fill").isNull() | (F.col("l_fill") == F.col("entry_fill_id")))))
    best = every.groupBy("trade_id").agg(F.min(F.struct("tier", "row_no")).alias("b")).select("trade_id", "b.tier", F.col("b.row_no").alias("lab_row"))
    return trades.join(best, "trade_id", "left")


def titles_of(day: Column) -> Column:
    """The three titles a day's pages have."""
    return F.array(F.date_format(day, "d MMM yyyy"), F.concat(F.lit("DRC "), F.date_format(day, "ddMMyy")), F.concat(F.lit("DRC "), F.date_format(day, "ddMMyyyy")))


def page_of_day(days: DataFrame, pages: DataFrame) -> DataFrame:
    """day, title, page_no: the first page, in input order, whose title (white space aside) is one of the day's."""
    plain = F.trim(F.regexp_replace("title", r"\s+", " "))
    j = days.select("day", F.explode(titles_of(F.col("day"))).alias("t")).join(pages.select("page_no", plain.alias("title")), F.col("t") == F.col("title"))
    return j.groupBy("day").agg(F.min(F.struct("page_no", "title")).alias("b")).select("day", "b.title", "b.page_no")


def remap_proposals(old: DataFrame, new: DataFrame, identity: Sequence[str]) -> DataFrame:
    """trade_id, status, state: decisions carried to new trade ids by entry identity; 'kept', 'remapped', 'discarded', or 'new'."""
    a = old.select(*identity, F.col("trade_id").alias("old_id"), "status")
    b = new.select(*identity, F.col("trade_id").alias("new_id"))
    j = a.join(b, list(identity), "full")
    state = F.when(F.col("new_id").isNull(), "discarded").when(F.col("old_id").isNull(), "new").when(F.col("old_id") == F.col("new_id"), "kept").otherwise("remapped")
    return j.select(F.coalesce("new_id", "old_id").alias("trade_id"), F.coalesce("status", F.lit("proposed")).alias("status"), state.alias("state"))


def keep_status(rebuilt: DataFrame, previous: DataFrame) -> DataFrame:
    """rebuilt proposals with the status that their trade id had before, else 'proposed'."""
    p = previous.select("trade_id", F.col("status").alias("__s"))
    return rebuilt.join(p, "trade_id", "left").withColumn("status", F.coalesce("__s", F.lit("proposed"))).drop("__s")


def attach_tags(tags: DataFrame, trades: DataFrame) -> DataFrame:
    """trade_id, tag: a session's tag goes to its only trade, or to trades that spoke it. tags: session_id, tag; trades: session_id, trade_id, spoken."""
    counted = trades.join(trades.groupBy("session_id").agg(F.count("*").alias("n")), "session_id")
    return counted.join(tags, "session_id").where((F.col("n") == 1) | F.array_contains("spoken", F.col("tag"))).select("trade_id", "tag")


def same_key_checks(checks: DataFrame, clips: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """session_id, verdict: checks made on the very recording a clip has now (digest, parts and duration)."""
    c = checks.select(F.col("session_id").alias("c_id"), F.col("sha").alias("c_sha"), F.col("parts").alias("c_parts"), F.col("duration_s").alias("c_dur"), "verdict")
    on = (F.col("session_id") == F.col("c_id")) & (F.col("sha") == F.col("c_sha")) & (F.col("parts") == F.col("c_parts")) & (F.abs(F.col("duration_s") - F.col("c_dur")) <= tolerance)
    return clips.join(c, on).select("session_id", "verdict")


def multiset_change(old: DataFrame, new: DataFrame, session: str, identity: Sequence[str]) -> DataFrame:
    """session, unchanged: both sides hold every identity equally often."""
    def counted(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(session, *identity).agg(F.count("*").alias(n))

    j = counted(old, "a").join(counted(new, "b"), [session, *identity], "full")
    return j.groupBy(session).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("unchanged"))


def membership(csv: DataFrame, stored: DataFrame, identity: Sequence[str]) -> DataFrame:
    """identity, place: 'both', 'csv' or 'stored'."""
    a, b = (d.select(*identity).distinct().withColumn(n, F.lit(True)) for d, n in ((csv, "a"), (stored, "b")))
    place = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "csv").otherwise("stored")
    return a.join(b, list(identity), "full").select(*identity, place.alias("place"))


def id_collisions(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """rec_id, action: 'new', 'same', 'overwrite' (another digest under the same name) or 'error'."""
    k = known.select(F.col("rec_id").alias("k_id"), F.col("digest").alias("k_digest"), F.col("name").alias("k_name"))
    j = incoming.join(k, F.col("rec_id") == F.col("k_id"), "left")
    action = F.when(F.col("k_id").isNull(), "new").when(F.col("digest") == F.col("k_digest"), "same").when(F.col("name") == F.col("k_name"), "overwrite").otherwise("error")
    return j.select("rec_id", action.alias("action"))


def orphan_parts(chained: DataFrame, digest: str = "digest") -> DataFrame:
    """Single recordings whose digest a later part of some chain has."""
    n = Window.partitionBy("chain")
    sized = chained.withColumn("__n", F.count("*").over(n))
    later = sized.where("__n > 1 and part > 1").select(F.col(digest).alias("__d")).distinct()
    return sized.where("__n = 1").join(later, F.col(digest) == F.col("__d"), "left_semi").select("rec_id")


def page_plan(days: DataFrame, saved: DataFrame, pages: DataFrame) -> DataFrame:
    """day, page_id, action: the saved page if it still has the title, else a page of that title, else a new one."""
    p = pages.select(F.col("page_id").alias("p_id"), F.col("title").alias("p_title"))
    s = saved.select("day", F.col("page_id").alias("s_id"))
    own = days.join(s, "day", "left").join(p, (F.col("s_id") == F.col("p_id")) & (F.col("title") == F.col("p_title")), "left").drop("p_title")
    by_title = pages.groupBy(F.col("title").alias("t_title")).agg(F.min("page_id").alias("t_id"))
    j = own.join(by_title, F.col("title") == F.col("t_title"), "left")
    page = F.coalesce("p_id", "t_id")
    return j.select("day", page.alias("page_id"), F.when(page.isNull(), "create").otherwise("update").alias("action"))


def unclaimed(outside: DataFrame, stored: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Outside fills that no neighbour's stored fills hold already; nulls of the identity match each other."""
    on = None
    s = stored.select(*(F.col(c).alias(f"__{c}") for c in identity)).distinct()
    for c in identity:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = same if on is None else on & same
    return outside.join(s, on, "left_anti")


def session_bundle(sessions: DataFrame, status: DataFrame, transcripts: DataFrame, insights: DataFrame) -> DataFrame:
    """session_id, bundle: session, stages and the optional transcript and insights as one JSON document."""
    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("session_id", F.struct(*[c for c in df.columns if c != "session_id"]).alias(name))

    j = part(sessions, "session").join(part(status, "status"), "session_id", "left").join(part(transcripts, "transcript"), "session_id", "left").join(part(insights, "insights"), "session_id", "left")
    return j.select("session_id", F.to_json(F.struct("session", "status", "transcript", "insights")).alias("bundle"))


def prose_lines(lines: DataFrame, allowed_ids: DataFrame, allowed_runs: DataFrame) -> DataFrame:
    """lines with problem: 'no cites', 'unknown cite', 'invented digits' or null. lines: line_id, session_id, text, cites; allowed_ids: session_id, id; allowed_runs: session_id, run."""
    cites = lines.select("line_id", "session_id", F.explode("cites").alias("id")).join(allowed_ids, ["session_id", "id"], "left_anti").select("line_id").distinct().withColumn("__c", F.lit(True))
    runs = lines.select("line_id", "session_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)))).alias("run"))
    bad = runs.join(allowed_runs.distinct(), ["session_id", "run"], "left_anti").select("line_id").distinct().withColumn("__r", F.lit(True))
    j = lines.join(cites, "line_id", "left").join(bad, "line_id", "left")
    problem = F.when(F.coalesce(F.size("cites"), F.lit(0)) <= 0, "no cites").when(F.col("__c"), "unknown cite").when(F.col("__r"), "invented digits")
    return j.withColumn("problem", problem).drop("__c", "__r")


def top_up(kept: DataFrame, fallback: DataFrame, key: str, n: int = 3) -> DataFrame:
    """key, pos, line: kept lines first, then fallback lines that aren't there yet, n at most. Both: key, ord, line."""
    both = kept.select(key, F.lit(0).alias("p"), "ord", "line").unionByName(fallback.select(key, F.lit(1).alias("p"), "ord", "line"))
    once = both.groupBy(key, "line").agg(F.min(F.struct("p", "ord")).alias("o"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("o", "line"))
    return once.withColumn("pos", pos.cast("long")).where(F.col("pos") <= n).select(key, "pos", "line")
