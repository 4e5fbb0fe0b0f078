"""SQL by which results are checked: the same operators for another engine."""

from __future__ import annotations

from ..sources import adapters
from . import catalog, lexicon
from .catalog import Recognizer

SHADOW = r"regexp_replace(regexp_replace({0}, '[^\x00-\x7F\P{{L}}]', 'a', 'g'), '[^\x00-\x7F]', ' ', 'g')"


def counts_as_bigint(text: str) -> str:
    """count_if has a wider type there; cast each call."""
    out, at = [], 0
    while (start := text.find("count_if(", at)) >= 0:
        end, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += (text[at:start], "CAST(coalesce(", text[start:end], ", 0) AS BIGINT)")
        at = end
    return "".join(out) + text[at:]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(terms) -> str:
    return "[" + ", ".join(quoted(t) for t in sorted(terms)) + "]"


def luhn(d: str) -> str:
    doubled = f"list_transform(list_transform(list_reverse(string_split({d}, '')), lambda x: CAST(x AS INTEGER)), lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)"
    return f"list_sum({doubled}) % 10 = 0"


def verhoeff(d: str) -> str:
    turned = f"list_transform(list_reverse(string_split({d}, '')), lambda x, i: {lexicon.VERHOEFF_TURN}[(i - 1) % 8 + 1][CAST(x AS INTEGER) + 1])"
    return f"list_reduce(list_prepend(0, {turned}), lambda a, b: {lexicon.VERHOEFF_PRODUCT}[a + 1][b + 1]) = 0"


def check(r: Recognizer) -> str:
    d = r"regexp_replace(value, '[^0-9]', '', 'g')"
    size = f"length({d}) = {r.length} AND " if r.length else ""
    if r.check == "octets":
        return r"len(list_filter(string_split(value, '.'), lambda x: CAST(x AS INTEGER) > 255)) = 0"
    if r.check == "gstin":
        code = "(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(value, CAST(k AS BIGINT), 1)) - 1)"
        return f"(36 - list_sum(list_transform(list_transform(range(1, 15), lambda k: {code} * (2 - k % 2)), lambda x: x // 36 + x % 36)) % 36) % 36 = list_transform([15], lambda k: {code})[1]"
    return {"luhn": size + luhn(d), "verhoeff": size + verhoeff(d), None: "true"}[r.check]


#: A recognizer of words, for joins on them.
WORD = (Recognizer("WORD", "word", ((r"\w+", 0.85),)),)


def detect(source: str, recognizers=catalog.RECOGNIZERS, boost: bool = True, more: str = "") -> str:
    """doc_id, entity_type, span_start, span_end, score over a SELECT of doc_id and text; repeated rows have spans each. ``more`` may be ``value``, the span's text."""
    also = f"{more}, " if more else ""
    parts = []
    for r in recognizers:
        for pattern, score in r.patterns:
            # No look-behind here: what must not stand before is matched with the value and cut off.
            ahead = pattern.startswith("(?<![\\w*])")
            regex = ("(?:^|[^\\w*])" + pattern.removeprefix("(?<![\\w*])")) if ahead else pattern
            q = quoted(regex)
            hit = "m[i]" if not ahead else r"regexp_replace(m[i], '^[^\w*]', '')"
            near = "lower(substr(s, 1, span_start))"
            toks = f"regexp_extract_all({near}, '[a-z0-9]+')"
            line = f"' ' || array_to_string({toks}[greatest(len({toks}) - 4, 1):], ' ') || ' '"
            found = " OR ".join(f"contains({line}, ' {w} ')" for w in r.context) or "false"
            value = f"round(least(1.0, CAST({score} AS DOUBLE) + CASE WHEN {found} THEN 0.35 ELSE 0.0 END), 4)" if boost else f"CAST({score} AS DOUBLE)"
            parts.append(f"""SELECT row_id, doc_id, '{r.entity}' AS entity_type, {also}span_start, span_start + length(value) AS span_end, {value} AS score FROM (
                SELECT row_id, doc_id, s, {hit} AS value,
                    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(m[i]) - length({hit}) AS INTEGER) AS span_start
                FROM (SELECT row_id, doc_id, s, regexp_extract_all(s, {q}) AS m, regexp_split_to_array(s, {q}) AS g FROM src) AS a, unnest(range(1, len(m) + 1)) AS u(i)) AS b WHERE {check(r)}""")
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH src AS (SELECT row_number() OVER () AS row_id, doc_id, {SHADOW.format('text')} AS s FROM ({source}) AS source)
        SELECT doc_id, entity_type, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end, {f"any_value({more}) AS {more}, " if more else ""}max(score) AS score FROM ({union}) AS hits GROUP BY row_id, doc_id, entity_type, span_start, span_end"""


#: The label as words: punctuation away, lower case, single characters joined to a short alphabetic word before them.
def label_norm(text: str) -> str:
    bare = rf"trim(lower(regexp_replace(regexp_replace({text}, '[^\p{{L}}\p{{N}}\sऀ-ॿ]+|_+', ' ', 'g'), '\s+', ' ', 'g')))"
    words = f"list_filter(string_split({bare}, ' '), lambda w: w <> '')"
    glue = "CASE WHEN length(w) = 1 AND len(acc) > 0 AND length(acc[-1]) <= 2 AND regexp_full_match(acc[-1], '\\p{L}+') THEN list_append(acc[:-2], acc[-1] || w) ELSE list_append(acc, w) END"
    lists = f"list_transform({words}, lambda w: [w])"
    return f"array_to_string(coalesce(list_reduce({lists}, lambda acc, v: {glue.replace('w)', 'v[1])').replace('|| w', '|| v[1]')}), []), ' ')"


def pii_label(norm: str) -> str:
    words = f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"
    terms = f"list_filter({words}, lambda w: NOT list_contains({listed(lexicon.FILLER)}, w))"
    return f"(list_has_any({terms}, {listed(lexicon.STRONG)}) OR (list_has_any({terms}, {listed(lexicon.WEAK)}) AND NOT list_has_any({terms}, {listed(lexicon.INSTITUTION)})))"


def label_phrase(norm: str) -> str:
    words = f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"
    return f"(len({words}) > 0 AND list_has_all({listed(lexicon.VOCABULARY)}, {words}))"


def tokens(text: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"


def overlap(a: str, b: str) -> str:
    side = lambda s, n: f"greatest(least({a}.{s} + {a}.{n}, {b}.{s} + {b}.{n}) - greatest({a}.{s}, {b}.{s}), 0)"
    return f"({side('\"left\"', 'width')} * {side('top', 'height')})"


SYNTH, FORMS, BOXES, WORDS = adapters.SYNTH_IDS, adapters.FORMS, adapters.BOXES, adapters.WORDS
DOCS = "SELECT doc_id, text FROM documents"
