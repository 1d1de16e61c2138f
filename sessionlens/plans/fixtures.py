"""Deterministic views that derive trading tables from the given tables.

Each view is one SQL text that Spark and DuckDB both run; only the words in ``_DIALECT``
differ. Prices are whole ticks and times whole microseconds, so that sums don't depend on
their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

#: name(argument) in the views: how Spark and DuckDB say it.
_DIALECT = {
    "us": ("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})", "epoch_us({})"),
    "words": ("split({}, ' ')", "string_split({}, ' ')"),
}

VIEWS: dict[str, str] = {
    # Purchases buy, clicks sell.
    "executions": """
        select event_id as fill_id, user_id, user_id % 7 as account,
               case when user_id % 2 = 0 then 'MNQ' else 'MES' end as instrument,
               case when user_id % 3 = 0 then null else concat('g', cast(user_id as string), ':', cast(cast(ts as date) as string)) end as source_group_id,
               case when event_type = 'purchase' then 'buy' else 'sell' end as side,
               cast(1 + event_id % 3 as bigint) as qty, cast(floor(value * 4) as bigint) as price_ticks,
               us(ts) as ts_us, cast(ts as date) as session_date
        from {events} where event_type in ('purchase', 'click')""",
    # A user's events without a gap of over six hours.
    "marks": """
        select event_id, user_id, event_type, value, us(ts) as t_us, cast(ts as date) as day,
               case when us(ts) - lag(us(ts)) over (partition by user_id order by ts, event_id) <= 21600000000 then 0 else 1 end as fresh
        from {events}""",
    "clip_events": """
        select *, sum(fresh) over (partition by user_id order by t_us, event_id rows between unbounded preceding and current row) as n from marks""",
    "clips": """
        select concat(cast(user_id as string), '-', cast(n as string)) as session_id, user_id, min(t_us) as start_us, max(t_us) as end_us,
               cast(count(*) as bigint) as n_events, min(day) as day
        from clip_events group by user_id, n""",
    "speech_events": """
        select c.session_id, c.user_id, c.start_us, e.t_us - c.start_us as t_us, concat('seg_', cast(e.event_id as string)) as seg,
               case when e.event_type = 'view' then 'hourly_checkin' when e.event_type = 'error' then 'tilt'
                    when e.event_id % 2 = 0 then 'no_trade_zone' else 'bias_statement' end as kind
        from clip_events e join clips c on c.session_id = concat(cast(e.user_id as string), '-', cast(e.n as string))
        where e.event_type in ('view', 'error', 'signup')""",
    "turns": """
        select conv_id, turn, role, text, cast(greatest(size_of(words(text)), 1) as bigint) * 400000 as len_us from {conversations}""",
    "segments": """
        select cast(conv_id as string) as session_id, turn, concat('seg_', cast(turn as string)) as seg, role, text,
               cast(sum(len_us) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) - len_us as t0_us,
               cast(sum(len_us) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) as t1_us
        from turns""",
    "readings": """
        select user_id, event_id, t_us - min(t_us) over (partition by user_id) as x_us, y
        from (select user_id * 100000 + cast(floor(us(ts) / 86400000000) as bigint) as user_id, event_id, us(ts) as t_us, cast(round(value * 100) as bigint) as y from {events}) d""",
    "recordings": """
        select user_id as prefix, event_id as rec_id, us(ts) as start_us,
               lead(us(ts)) over (partition by user_id order by ts, event_id) - us(ts) + (event_id % 21 - 10) * 1000000 as dur_us
        from {events}""",
    "recorder_events": """
        select session_id, row_no, n_rows, wall_us,
               case when row_no = 1 then 'record_start' when row_no = n_rows then 'record_stop' when row_no % 2 = 0 then 'pause' else 'resume' end as event,
               (row_no - 1) * 600000000 as video_us
        from (select concat(cast(user_id as string), '-', cast(n as string)) as session_id, t_us as wall_us,
                     cast(row_number() over (partition by user_id, n order by t_us, event_id) as bigint) as row_no,
                     cast(count(*) over (partition by user_id, n) as bigint) as n_rows from clip_events) x""",
    "recon": """
        select distinct session_date, case when extract(day from session_date) % 2 = 0 then instrument else '' end as instrument,
               concat('s', cast(extract(day from session_date) % 7 as string)) as status
        from executions where extract(day from session_date) % 5 <> 0""",
}
_DIALECT["size_of"] = ("size({})", "len({})")


def _needs(text: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b(?:from|join)\s+\(?{n}\b", text)]


def _speak(text: str, at: int) -> str:
    """Replaces the dialect's calls, innermost first."""
    while True:
        m = None
        for m in re.finditer(r"\b(" + "|".join(_DIALECT) + r")\(", text):
            pass
        if not m:
            return text
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[: m.start()] + _DIALECT[m[1]][at].format(text[m.end() : i - 1]) + text[i:]


def ctes(*names: str, at: int = 1) -> str:
    """The views and those below them as the inside of a WITH; at: 0 for Spark, 1 for DuckDB."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _needs(VIEWS[n]):
            if x != n:
                add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    out = ", ".join(f"{n} AS ({_speak(VIEWS[n], at)})" for n in order)
    return re.sub(r"\{(\w+)\}", r"\1", out) if at else out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = f"WITH {ctes(name, at=0)} SELECT * FROM {name}"
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used})


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
