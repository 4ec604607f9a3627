"""Column builders for catalogue text: tokens, query analysis, identity and derived texts.

Everything is built from native functions. Tables that results depend on are
stated as fixed values.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own in a query.
GENERIC_TERMS = (
    "a an and app application applications alternative alternatives build building built for from in library of open platform project repo "
    "repository service source system the to tool tools use with"
).split()
# Joining words of queries, words that ask for alternatives, words that name a domain.
QUERY_JOINERS = "a an and for in of or the to with".split()
ALTERNATIVE_TERMS = "alternative alternatives replace replacement similar like".split()
DOMAIN_CUES = "for in with domain industry pipelines infrastructure observability".split()
# Programming languages and what they are called, first names first.
LANGUAGES = {
    "python": ["python", "py"],
    "javascript": ["javascript", "js"],
    "typescript": ["typescript", "ts"],
    "rust": ["rust"],
    "go": ["go", "golang"],
    "java": ["java"],
    "php": ["php"],
    "ruby": ["ruby"],
    "c": ["c"],
    "c++": ["c++", "cpp", "cplusplus"],
    "c#": ["c#", "csharp"],
    "scala": ["scala"],
    "swift": ["swift"],
    "kotlin": ["kotlin"],
    "dart": ["dart"],
    "vue": ["vue"],
    "shell": ["shell", "bash", "sh", "zsh"],
    "jupyter notebook": ["jupyter notebook", "jupyter-notebook", "jupyter", "ipynb"],
}
# Words left out of generated keyword phrases.
NOISE_TOKENS = (
    "and application applications build building built for from has helps into open opensource project projects provide provides source support "
    "supports system that the this tool tools using with"
).split()
EXACT_NAME_TOKENS = 3
# Fixed value: white space of all scripts.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = "[a-z0-9][a-z0-9+._#-]*"
EMBEDDING_INPUT_VERSION = 3


def words(values: list[str] | tuple[str, ...]) -> Column:
    """A constant array, folded by the optimiser from one literal: as many calls whatever its length."""
    return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def stripped(text: Column) -> Column:
    """text without white space at its ends, of any script; null where nothing is left."""
    return F.nullif(F.btrim(text, F.lit(WHITE_SPACE)), F.lit(""))


def strip_list(values: Column) -> Column:
    """Stripped values, blank and null ones left out; an empty list for null."""
    return F.coalesce(F.filter(F.transform(values, stripped), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def clean_list(values: Column) -> Column:
    """strip_list without repeats."""
    return F.array_distinct(strip_list(values))


def nonblank(values: Column) -> Column:
    """Values as they are, blank and null ones left out."""
    return F.coalesce(F.filter(values, lambda x: stripped(x).isNotNull()), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def expanded(token: Column) -> Column:
    """A token, its parts, and each one's other number: tools for tool and tool for tools."""
    parts = F.array_union(F.array(token), F.filter(F.split(token, "[-._#]+"), lambda p: p != ""))
    other = F.transform(parts, lambda v: F.when(v.endswith("s") & (F.length(v) > 3), F.substring(v, F.lit(1), F.length(v) - 1)).when(F.length(v) > 2, F.concat(v, F.lit("s"))))
    return F.array_union(parts, F.array_compact(other))


def expanded_all(values: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(values, expanded)))


def _alias_of(token: Column) -> Column:
    """The language that one token names, or null."""
    names = {a: n for n, aliases in LANGUAGES.items() for a in aliases if " " not in a}
    return F.try_element_at(_mapped(names), token)


def _mapped(names: dict[str, str]) -> Column:
    """A constant map of texts without commas and colons, from one literal."""
    return F.str_to_map(F.lit(",".join(f"{a}:{n}" for a, n in names.items())), F.lit(","), F.lit(":"))


def language_prefix(query_tokens: Column) -> Column:
    """The tokens at a query's start that name a language, the longest such run."""
    two = (F.get(query_tokens, 0) == "jupyter") & (F.get(query_tokens, 1) == "notebook")
    one = _alias_of(F.get(query_tokens, 0)).isNotNull()
    return F.when(F.coalesce(two, F.lit(False)), F.slice(query_tokens, 1, 2)).when(F.coalesce(one, F.lit(False)), F.slice(query_tokens, 1, 1)).otherwise(F.array().cast("array<string>"))


def query_language(query_tokens: Column) -> Column:
    return _alias_of(F.get(query_tokens, 0))


def metadata_language(language: Column) -> Column:
    """The first language, in their fixed order, of the names in a text; null if none."""


    def first(found: Column) -> Column:
        # Aliases that the tokens are, or make when joined, in the languages' order.
        names = {a: n for n, aliases in LANGUAGES.items() for a in aliases}
        said = F.concat(found, F.array(F.array_join(found, ""), F.array_join(found, " ")))
        known = bound(said, lambda x: F.get(F.filter(words(list(names)), lambda a: F.array_contains(x, a)), 0))
        return F.try_element_at(_mapped(names), known)

    return bound(tokens(language), first)


def keywords(query: Column) -> Column:
    """Distinct telling tokens of a query, sorted."""
    stop = words(sorted({*GENERIC_TERMS, *QUERY_JOINERS}))
    telling = lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$")
    return bound(tokens(query), lambda found: F.array_sort(F.array_except(F.filter(found, telling), language_prefix(found))))


def intent_type(query: Column) -> Column:
    found = tokens(query)
    plain = ~F.arrays_overlap(found, words(sorted({*GENERIC_TERMS, *QUERY_JOINERS})))
    return (
        F.when(F.size(found) == 0, "empty")
        .when(F.contains(query, F.lit("/")) | ((F.size(found) <= EXACT_NAME_TOKENS) & plain), "exact_name")
        .when(F.arrays_overlap(found, words(ALTERNATIVE_TERMS)), "alternative")
        .when(F.arrays_overlap(found, words(DOMAIN_CUES)) & (F.size(keywords(query)) >= 2), "domain")
        .otherwise("functional")
    )


def intent(query: Column) -> Column:
    """struct(type, specificity, keywords, primary_language)."""
    telling = keywords(query)
    return F.struct(
        intent_type(query).alias("type"),
        F.least(F.lit(1.0), F.size(telling) / 5.0).alias("specificity"),
        telling.alias("keywords"),
        query_language(tokens(query)).alias("primary_language"),
    )


def lowered(text: Column) -> Column:
    return F.coalesce(F.lower(stripped(text)), F.lit(""))


def spelled(text: Column) -> Column:
    """A text's tokens joined in five ways."""
    joins = lambda found: F.array_distinct(F.array(*(F.array_join(found, glue) for glue in (" ", "", "-", "_", "."))))
    return bound(tokens(F.replace(text, F.lit("/"), F.lit(" "))), lambda found: F.when(F.size(found) > 0, joins(found)).otherwise(F.array().cast("array<string>")))


def query_variants(query: Column) -> Column:
    return F.filter(F.array_union(F.array(lowered(query)), spelled(query)), lambda x: x != "")


def identity_values(repo_id: Column, name: Column, aliases: Column) -> Column:
    """What an entry goes by: its id, name, owner and repository, and aliases."""
    parts = F.when(F.contains(repo_id, F.lit("/")), F.split(repo_id, "/")).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.coalesce(repo_id, F.lit("")), F.coalesce(name, F.lit(""))), F.coalesce(parts, F.array().cast("array<string>")), strip_list(aliases))
    return F.filter(every, lambda x: stripped(x).isNotNull())


def identity_variants(values: Column) -> Column:
    each = F.flatten(F.transform(values, lambda v: F.concat(F.array(lowered(v)), spelled(v))))
    return F.filter(F.array_distinct(each), lambda x: x != "")


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u3400-\\u9fff]")


def _language_terms() -> list[str]:
    out = {t for aliases in LANGUAGES.values() for a in aliases for t in a.split()}
    return sorted(out)


def called_names(name: Column, aliases: Column) -> Column:
    """The name and aliases, stripped, that a text without spaces between words may hold."""
    return F.filter(F.transform(F.concat(F.array(F.coalesce(name, F.lit(""))), aliases), lowered), lambda v: (F.length(v) >= 3) & ~F.array_contains(words(_language_terms()), v))


def identity_kind(query: Column, repo_id: Column, name: Column, aliases: Column) -> Column:
    """How a query names an entry: repo_id, exact_value, contextual_name_mention, name_mention or none."""
    raw, own = lowered(query), lowered(repo_id)
    values = identity_values(repo_id, name, aliases)
    called = called_names(name, strip_list(aliases))
    return (
        F.when((own != "") & F.contains(raw, own), "repo_id")
        .when(F.array_contains(F.transform(values, lowered), raw), "exact_value")
        .when(has_cjk(query), F.when(F.exists(called, lambda v: F.contains(raw, v)), "contextual_name_mention").otherwise("none"))
        .when(F.arrays_overlap(query_variants(query), identity_variants(values)), "name_mention")
        .otherwise("none")
    )


def joined_lines(scalars: list[Column], lists: list[Column], glue: str = "\n", strip: bool = False) -> Column:
    """Non-blank scalars, then the lists' values, one a line."""
    shape: Callable[[Column], Column] = stripped if strip else lambda c: F.when(stripped(c).isNotNull(), c)
    parts = [F.array(*map(shape, scalars))] + [strip_list(values) for values in lists]
    return F.array_join(F.array_compact(F.concat(*parts)), glue)


def metadata_text(m: Callable[[str], Column]) -> Column:
    scalars = [m(k) for k in ("name", "description", "summary", "language", "project_type", "search_text")]
    lists = [m(k) for k in ("aliases", "topics", "use_cases", "capabilities", "ecosystem", "replaces", "related_projects", "search_phrases")]
    return joined_lines(scalars, lists)


def rerank_text(repo_id: Column, m: Callable[[str], Column]) -> Column:
    scalars = [repo_id, *(m(k) for k in ("name", "description", "summary", "search_text", "language", "project_type"))]
    return joined_lines(scalars, [m(k) for k in ("topics", "use_cases", "capabilities", "ecosystem", "search_phrases")], strip=True)


def embedding_text(repo_id: Column, name: Column, github: Callable[[str], Column], profile: Callable[[str], Column]) -> Column:
    """What of a record is embedded; '' where it has nothing but a name."""
    given = lambda c: F.nullif(c, F.lit(""))
    listed = lambda c: given(F.array_join(c, ", "))
    content = F.array_compact(
        F.array(
            stripped(profile("search_text")), given(github("description")), listed(github("topics")), given(github("language")), given(profile("summary")),
            listed(profile("use_cases")), listed(profile("capabilities")), listed(profile("search_phrases")),
        )
    )
    called = F.array_compact(F.array(F.coalesce(given(repo_id), given(name))))
    lines = lambda c: F.coalesce(stripped(F.array_join(F.concat(called, c), "\n")), F.lit(""))
    return bound(content, lambda c: F.when(F.size(c) == 0, "").otherwise(lines(c)))


def json_string(text: Column) -> Column:
    """text as a JSON string, non-ASCII kept, control escapes in lower-case hex."""

    def lower_hex(encoded: Column) -> Column:
        out = encoded
        for code in (11, 14, 15, *range(26, 32)):
            out = F.replace(out, F.lit(f"\\u00{code:02X}"), F.lit(f"\\u00{code:02x}"))
        return F.when(F.contains(encoded, F.lit("\\u00")), out).otherwise(encoded)

    return bound(bound(F.to_json(F.struct(text.alias("t"))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6)), lower_hex)


def fingerprint(text: Column, version: int = EMBEDDING_INPUT_VERSION) -> Column:
    """sha256 of an embedding input and its version; null for ''."""
    head = F.lit(f'{{"embedding_input_version": {version}, "text": ')
    return bound(text, lambda t: F.when(t != "", F.sha2(F.concat(head, json_string(t), F.lit("}")), 256)))


def readme_excerpt(text: Column, limit: int = 1200) -> Column:
    """The telling lines of a read-me: no blank, image, badge or bare mark-up lines."""
    lines = F.transform(F.split(text, "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"), lambda line: F.coalesce(stripped(line), F.lit("")))
    kept = F.filter(
        lines,
        lambda x: (x != "") & ~x.startswith("[!") & ~x.startswith("![") & ~F.contains(x, F.lit("img.shields.io")) & ~F.contains(x, F.lit("badge.svg")) & ~x.rlike("(?U)^[#*`_\\-\\s]+$"),
    )
    return F.nullif(F.substring(F.array_join(kept, "\n"), 1, limit), F.lit(""))


def repo_parse(value: Column) -> Column:
    """struct(repo_id, reason): owner/repository of an id or URL, or why there is none."""
    v = F.coalesce(stripped(value), F.lit(""))
    is_url = v.startswith("http://") | v.startswith("https://")
    host = F.lower(F.regexp_extract(v, "^https?://([^/?#]*)", 1))
    path = F.filter(F.split(F.regexp_extract(v, "^https?://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    parts = F.split(v, "/")
    reason = (
        F.when(v == "", "empty")
        .when(is_url & (host != "github.com"), "not_github")
        .when(is_url & (F.size(path) < 2), "no_owner_and_repo")
        .when(~is_url & ((F.size(parts) != 2) | F.exists(parts, lambda p: p == "")), "not_owner_repo")
    )
    found = F.when(is_url, F.concat_ws("/", F.get(path, 0), F.get(path, 1))).otherwise(v)
    return F.struct(F.when(reason.isNull(), found).alias("repo_id"), reason.alias("reason"))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(80)), F.lit("")), F.lit("case"))


def normal_query(text: Column) -> Column:
    return F.lower(F.coalesce(stripped(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")))


def signature(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")


def keyword_list(text: Column, limit: int) -> Column:
    telling = F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$") & ~F.array_contains(words(NOISE_TOKENS), t))
    return F.slice(F.array_distinct(telling), 1, limit)


def keyword_phrase(text: Column, limit: int = 6) -> Column:
    return F.nullif(F.array_join(keyword_list(text, limit), " "), F.lit(""))


def keywords_of(values: Column, limit: int = 6) -> Column:
    """A phrase of several texts' keywords."""
    each = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: keyword_list(v, 2 * limit)))
    return F.nullif(F.array_join(F.slice(F.array_distinct(each), 1, limit), " "), F.lit(""))


def topic_phrase(topics: Column, limit: int) -> Column:
    return F.nullif(F.array_join(F.slice(F.filter(topics, lambda t: F.length(t) > 1), 1, limit), ", "), F.lit(""))


def join_parts(*parts: Column | str) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else stripped(p) for p in parts]
    return F.nullif(F.concat_ws(" ", *columns), F.lit(""))


def distinct_by_text(values: Column) -> Column:
    """Non-empty values, the first of each normalised text, in order."""
    some = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.filter(some, lambda v, i: F.array_position(F.transform(some, normal_query), normal_query(v)) == i + 1)


def fenced_json(content: Column) -> Column:
    """The JSON of a model's answer, without the code fence around it."""
    text = F.coalesce(stripped(content), F.lit(""))
    bare = F.regexp_replace(text, "^`+|`+$", "")
    bare = F.when(F.lower(F.left(bare, F.lit(4))) == "json", F.substring(bare, 5, 1 << 30)).otherwise(bare)
    return F.when(text.startswith("```"), F.coalesce(stripped(bare), F.lit(""))).otherwise(text)


def prompt_hash(version: int, system: str) -> str:
    """sha256 of a prompt's version and system text as sorted JSON; the same for all rows."""
    return hashlib.sha256(json.dumps({"prompt_version": version, "system_prompt": system}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
