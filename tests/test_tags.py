"""Tag grammar: the codes of small tag sets."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import tags

G = tags.TagGrammar(
    playbooks={"ODG": True, "OLD": False, "MA": True}, aliases={"GDO": "ODG"}, variants={"ODG": ["V_a"], "MA": "ma_pair"}, entries=["E_LIMIT", "E_STOP"], triggers={"3c": True, "x": False},
    vocabulary=["lvl", "POC"], confirm=["5m9ema", "5m21ema"], qualifiers=["-R"], control=["RE_OPEN"], effective_from=date(2026, 1, 1),
)
OK = ["PB_ODG", "E_LIMIT", "lvl"]


@pytest.mark.parametrize(
    "given,codes",
    [
        (OK, []), (["PB_GDO", "E_LIMIT", "POC-R"], []), (["E_LIMIT", "lvl"], ["playbook_missing"]), ([*OK, "PB_MA"], ["playbook_multiple"]), (["PB_ZZ", "E_LIMIT", "lvl"], ["playbook_unknown"]),
        (["PB_OLD", "E_LIMIT", "lvl"], ["playbook_inactive"]), (["PB_ODG", "lvl"], ["entry_missing"]), ([*OK, "E_STOP"], ["entry_multiple"]), ([*OK, "V_a"], []), ([*OK, "V_b"], ["variant_not_allowed"]),
        ([*OK, "V_a", "V_b"], ["variant_multiple"]), (["PB_MA", "E_LIMIT", "lvl", "V_5m_9ema_21ema"], []), (["PB_MA", "E_LIMIT", "lvl", "V_5m_21ema_9ema"], ["variant_not_allowed"]),
        ([*OK, "T_3c"], []), ([*OK, "T_y"], ["trigger_unknown"]), ([*OK, "T_x"], ["trigger_inactive"]), ([*OK, "T_x", "T_3c"], ["trigger_multiple"]), ([*OK, "bad tag"], ["charset_violation"]), ([*OK, "zzz"], ["unknown_tag"]),
        (["PB_ODG", "E_LIMIT", "C_NONE"], []), ([*OK, "C_NONE"], ["c_none_with_confluence"]), (["PB_ODG", "E_LIMIT"], ["confluence_missing"]), ([*OK, "RE_OPEN"], ["reentry_unresolved"]),
        ([*OK, "X_1"], ["unknown_reserved"]), ([*OK, "E_ZZ"], ["unknown_reserved"]), ([*OK, "C_2"], ["unknown_reserved"]), ([*OK, "PB_"], ["unknown_reserved"]), (None, ["confluence_missing", "entry_missing", "playbook_missing"]),
    ],
)
def test_codes(spark, given, codes):
    df = spark.createDataFrame([("t", given)], "trade_id string, tags array<string>")
    assert sorted(r["code"] for r in tags.grammar_errors(df, G).collect()) == codes


def test_grammar_starts_on_its_day(spark):
    df = spark.createDataFrame([(date(2025, 12, 31),), (date(2026, 1, 1),), (None,)], "d date")
    assert [r[0] for r in df.select(tags.active(F.col("d"), G)).collect()] == [False, True, False]
