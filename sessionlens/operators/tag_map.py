"""Mapping free text to the tags of a closed vocabulary.

Stages: the whole text is a tag or a known spelling of one; else it is one when only its
letters and digits count; else all longest hits in it that don't overlap, from left to right, and then
each word by itself, if need be without a qualifier at its end. Words that are unknown fall out.
The vocabulary becomes one pattern, a trie of the spellings' characters, so a text is read
once whatever the number of tags; every stage is a built-in function on the row.
Null and blank texts have no tags; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import TagGrammar, active, ma_pair_ok

WORD = r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*"


@dataclass(frozen=True)
class TagMap:
    """exact: tags and another spelling of each, if it has one; context: further tags; qualifiers: endings that a word may have."""

    exact: Mapping[str, str | None]
    context: Sequence[str] = ()
    qualifiers: Sequence[str] = ()
    #: Tags that hold from the grammar's first day on, besides its open pattern.
    grammar: TagGrammar | None = None
    grammar_tags: Sequence[str] = field(default=())

    def spellings(self, with_grammar: bool) -> dict[str, str]:
        """Lower-case spelling to tag; of equal spellings the first counts: tags, context, other spellings, the grammar's."""
        out: dict[str, str] = {}
        for tag in (*self.exact, *self.context):
            out.setdefault(tag.lower(), tag)
        for tag, other in self.exact.items():
            if other:
                out.setdefault(other.lower(), tag)
        for tag in self.grammar_tags if with_grammar else ():
            out.setdefault(tag.lower(), tag)
        return out


def trie_pattern(words: Iterable[str]) -> str:
    """A pattern that matches one of the words, at a place the longest that can be; common beginnings are shared."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        # A tail without forks is one literal; recursion is as deep as the longest word has forks.
        text = ""
        while len(node) == 1 and "" not in node:
            (c, node), = node.items()
            text += _literal(c)
        branches = [_literal(c) + render(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return text
        return text + "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    return render(root)


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_ " else "\\" + c


def _lookup(entries: Mapping[str, str], key: Column) -> Column:
    if not entries:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in entries.items() for x in kv)), key)


def _without_nulls(items: Column) -> Column:
    return F.filter(items, lambda t: t.isNotNull())


def _stages(text: Column, tag_map: TagMap, with_grammar: bool) -> Column:
    spellings = tag_map.spellings(with_grammar)
    closed = tag_map.spellings(False)
    compact: dict[str, str] = {}
    for spelling, tag in spellings.items():
        short = "".join(c for c in spelling if c in "abcdefghijklmnopqrstuvwxyz0123456789")
        if short and len(tag) > len(compact.get(short, "")):
            compact[short] = tag
    whole = _lookup(spellings, F.lower(text))
    bare = _lookup(compact, F.regexp_replace(F.lower(text), "[^a-z0-9]", ""))
    pattern = rf"(?i)(?<![A-Za-z0-9_]){trie_pattern(spellings)}(?![A-Za-z0-9_])" if spellings else "(?!)"
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: _lookup(spellings, F.lower(t)))

    def word(t: Column) -> Column:
        low = F.lower(t)
        found = [_lookup(closed, low)]
        for q in sorted(tag_map.qualifiers, key=len, reverse=True):
            found.append(F.when(F.endswith(low, F.lit(q.lower())) & (F.length(t) > len(q)), _lookup(closed, F.substring(low, F.lit(1), F.length(low) - len(q)))))
        if with_grammar:
            found.append(_lookup({t.lower(): t for t in tag_map.grammar_tags}, low))
            if tag_map.grammar:
                found.append(F.when(ma_pair_ok(t, tag_map.grammar), t))
        return F.coalesce(*found)

    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), word)
    return F.when(whole.isNotNull(), F.array(whole)).when(bare.isNotNull(), F.array(bare)).otherwise(F.array_distinct(_without_nulls(F.concat(hits, words))))


def mapped_tags(text: Column, tag_map: TagMap, as_of: Column | None = None) -> Column:
    """The tags of a text in the order in which they were found; those of the grammar only from its first day on."""
    blob = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    none = F.array().cast("array<string>")
    plain = _stages(blob, tag_map, False)
    if as_of is not None and tag_map.grammar:
        plain = F.when(active(as_of, tag_map.grammar), _stages(blob, tag_map, True)).otherwise(plain)
    return F.when(blob == "", none).otherwise(plain)
