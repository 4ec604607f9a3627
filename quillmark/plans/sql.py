"""Pieces of SQL that oracles share."""

from __future__ import annotations

from ..functions.text import ALTERNATIVE_TERMS, DOMAIN_CUES, GENERIC_TERMS, LANGUAGES, QUERY_JOINERS

TOKEN = "[a-z0-9][a-z0-9+._#-]*"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STOP = names(sorted({*GENERIC_TERMS, *QUERY_JOINERS}))


def forms(t: str) -> str:
    """All forms of a token."""
    parts = f"list_distinct(list_concat([{t}], list_filter(regexp_split_to_array({t}, '[-._#]+'), lambda p: p <> '')))"
    other = f"list_transform({parts}, lambda v: CASE WHEN suffix(v, 's') AND len(v) > 3 THEN v[:-2] WHEN len(v) > 2 THEN v || 's' END)"
    return f"list_distinct(list_concat({parts}, list_filter({other}, lambda z: z IS NOT NULL)))"


def all_forms(tokens: str) -> str:
    return f"list_distinct(flatten(list_transform({tokens}, lambda t: {forms('t')})))"


def alias(t: str) -> str:
    """The language that a token names."""
    return "CASE " + " ".join(f"WHEN list_contains({names(a for a in v if ' ' not in a)}, {t}) THEN '{k}'" for k, v in LANGUAGES.items()) + " END"


def prefix(tokens: str) -> str:
    return f"CASE WHEN {tokens}[1] = 'jupyter' AND {tokens}[2] = 'notebook' THEN {tokens}[1:2] WHEN {alias(tokens + '[1]')} IS NOT NULL THEN {tokens}[1:1] ELSE []::VARCHAR[] END"


def keywords(x: str) -> str:
    t = tok(x)
    return (
        f"list_sort(list_distinct(list_filter({t}, lambda w: len(w) > 1 AND NOT list_contains({STOP}, w)"
        f" AND NOT list_contains({prefix(t)}, w) AND NOT regexp_full_match(w, '[0-9]+'))))"
    )


def intent(x: str) -> str:
    t = tok(x)
    return (
        f"CASE WHEN len({t}) = 0 THEN 'empty' WHEN contains({x}, '/') OR (len({t}) <= 3 AND NOT list_has_any({t}, {STOP})) THEN 'exact_name'"
        f" WHEN list_has_any({t}, {names(ALTERNATIVE_TERMS)}) THEN 'alternative'"
        f" WHEN list_has_any({t}, {names(DOMAIN_CUES)}) AND len({keywords(x)}) >= 2 THEN 'domain' ELSE 'functional' END"
    )


def spelled(x: str) -> str:
    t = tok(f"replace({x}, '/', ' ')")
    return f"CASE WHEN len({t}) > 0 THEN [" + ", ".join(f"array_to_string({t}, '{g}')" for g in (" ", "", "-", "_", ".")) + "] ELSE []::VARCHAR[] END"


def variants(x: str) -> str:
    return f"list_distinct(list_filter(list_concat([lower(trim({x}))], {spelled(x)}), lambda v: v <> ''))"


def identity(query: str, repo: str, name: str) -> str:
    """How a query names an entry without aliases."""
    parts = f"CASE WHEN contains({repo}, '/') THEN string_split({repo}, '/') ELSE []::VARCHAR[] END"
    values = f"list_filter(list_concat([{repo}, coalesce({name}, '')], {parts}), lambda v: trim(v) <> '')"
    spelt = f"flatten(list_transform({values}, lambda v: {variants('v')}))"
    raw = f"lower(trim({query}))"
    return (
        f"CASE WHEN contains({raw}, lower({repo})) THEN 'repo_id' WHEN list_contains(list_transform({values}, lambda v: lower(trim(v))), {raw}) THEN 'exact_value'"
        f" WHEN list_has_any({variants(query)}, {spelt}) THEN 'name_mention' ELSE 'none' END"
    )


def bucket(x: str) -> str:
    return f"CASE WHEN {x} >= 0.60 THEN 'high_confidence' WHEN {x} >= 0.35 THEN 'exploratory' ELSE 'abstain' END"
