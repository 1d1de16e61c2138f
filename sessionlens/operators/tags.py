"""Tag grammar: which sets of tags a trade may have.

Tags are classed by prefix: PB_ playbook, E_ entry, V_ variant, T_ trigger, C_ confluence marker, X_ reserved; all others are
confluence tags. The vocabulary is configuration and becomes literals; every trade is judged in its own row, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARSET = r"^[\p{L}\p{N}_.:+/-]+$"


@dataclass(frozen=True)
class TagGrammar:
    """playbooks and triggers: active by name; aliases: old playbook name to new; variants: allowed by playbook ('ma_pair' for the open pattern)."""

    playbooks: Mapping[str, bool]
    aliases: Mapping[str, str]
    variants: Mapping[str, Sequence[str] | str]
    entries: Sequence[str]
    triggers: Mapping[str, bool]
    vocabulary: Sequence[str]
    confirm: Sequence[str] = ()
    qualifiers: Sequence[str] = ()
    control: Sequence[str] = ()
    confluence_none: str = "C_NONE"
    ma_pair: str = r"^V_(\d+[mh])_(\d+)([a-z]+)_(\d+)([a-z]+)$"
    effective_from: date | None = None
    charset: str = field(default=CHARSET)


def active(as_of: Column, grammar: TagGrammar) -> Column:
    """Whether the grammar holds on a day: from its first day on, never without one or without a day."""
    return F.coalesce(as_of >= F.lit(grammar.effective_from), F.lit(False)) if grammar.effective_from else F.lit(False)


def _list(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def ma_pair_ok(variant: Column, grammar: TagGrammar) -> Column:
    """Both legs are confirm keys of the same time frame, the shorter one first."""
    def part(i: int) -> Column:
        return F.regexp_extract(variant, grammar.ma_pair, i)

    known = _list(grammar.confirm)
    legs = F.array_contains(known, F.concat(part(1), part(2), part(3))) & F.array_contains(known, F.concat(part(1), part(4), part(5)))
    return F.coalesce(legs & (part(2).try_cast("int") < part(4).try_cast("int")), F.lit(False))


def grammar_errors(trades: DataFrame, grammar: TagGrammar, tags: str = "tags") -> DataFrame:
    """trade_id, code, tag: what is wrong with each trade's tags; tag is null where a whole class is."""
    every = F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))
    plain = F.filter(every, lambda t: ~F.array_contains(_list(grammar.control), t))

    def of(prefix: str) -> Column:
        return F.array_sort(F.filter(plain, lambda t: t.startswith(prefix) & (t != F.lit(prefix))))

    classed = trades.select(
        "trade_id", F.filter(every, lambda t: F.array_contains(_list(grammar.control), t)).alias("control"), of("PB_").alias("pb"), of("T_").alias("tr"),
        F.filter(of("E_"), lambda t: F.array_contains(_list(grammar.entries), t)).alias("en"), F.array_sort(F.filter(plain, lambda t: t.startswith("V_"))).alias("va"),
        F.filter(plain, lambda t: t == grammar.confluence_none).alias("none"),
        F.filter(plain, lambda t: t.isin("PB_", "T_", "E_") | t.startswith("X_") | (t.startswith("E_") & ~F.array_contains(_list(grammar.entries), t)) | (t.startswith("C_") & (t != grammar.confluence_none))).alias("reserved"),
        F.filter(plain, lambda t: ~t.rlike("^(PB_|T_|E_|C_|X_|V_)")).alias("co"),
    )

    def joined(c: str) -> Column:
        return F.array_join(c, ",")

    def err(code: str, when: Column, tag: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(None).cast("string") if tag is None else tag).alias("tag")))

    def each(code: str, c: Column) -> Column:
        return F.transform(c, lambda t: F.struct(F.lit(code).alias("code"), t.alias("tag")))

    name = F.substring(F.col("pb")[0], 4, 1000)
    current = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in grammar.aliases.items() for x in kv)), name), name) if grammar.aliases else name
    known, idle = _list(list(grammar.playbooks)), _list([k for k, on in grammar.playbooks.items() if not on])
    one = F.size("pb") == 1
    usable = one & F.array_contains(known, current) & ~F.array_contains(idle, current)
    variant = F.try_element_at("va", F.lit(1))
    fits = F.lit(False)
    for p, allowed in grammar.variants.items():
        fits = F.when(current == p, ma_pair_ok(variant, grammar) if allowed == "ma_pair" else F.array_contains(_list(allowed), variant)).otherwise(fits)
    trigger = F.substring(F.try_element_at("tr", F.lit(1)), 3, 1000)
    t_known, t_idle = _list(list(grammar.triggers)), _list([k for k, on in grammar.triggers.items() if not on])
    vocabulary = _list(grammar.vocabulary)

    def known_tag(t: Column) -> Column:
        ok = F.array_contains(vocabulary, t)
        for q in grammar.qualifiers:
            ok = ok | (t.endswith(q) & F.array_contains(vocabulary, F.left(t, F.length(t) - len(q))))
        return ok

    single = F.array(
        err("playbook_missing", F.size("pb") == 0), err("playbook_multiple", F.size("pb") > 1, joined("pb")), err("playbook_unknown", one & ~F.array_contains(known, current), F.try_element_at("pb", F.lit(1))),
        err("playbook_inactive", one & F.array_contains(idle, current), F.try_element_at("pb", F.lit(1))), err("entry_missing", F.size("en") == 0), err("entry_multiple", F.size("en") > 1, joined("en")),
        err("variant_multiple", F.size("va") > 1, joined("va")), err("variant_not_allowed", (F.size("va") == 1) & usable & ~fits, variant), err("trigger_multiple", F.size("tr") > 1, joined("tr")),
        err("trigger_unknown", (F.size("tr") == 1) & ~F.array_contains(t_known, trigger), F.try_element_at("tr", F.lit(1))), err("trigger_inactive", (F.size("tr") == 1) & F.array_contains(t_idle, trigger), F.try_element_at("tr", F.lit(1))),
        err("c_none_with_confluence", (F.size("none") > 0) & (F.size("co") > 0)), err("confluence_missing", (F.size("none") == 0) & (F.size("co") == 0)),
    )
    many = F.concat(
        F.filter(single, lambda e: e.isNotNull()), each("reentry_unresolved", F.col("control")), each("unknown_reserved", F.col("reserved")),
        each("charset_violation", F.filter("co", lambda t: ~t.rlike(grammar.charset))), each("unknown_tag", F.filter("co", lambda t: t.rlike(grammar.charset) & ~known_tag(t))),
    )
    return classed.select("trade_id", F.explode(many).alias("e")).select("trade_id", "e.code", "e.tag")
