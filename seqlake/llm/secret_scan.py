"""Secret scanning with a trigram index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: what must occur in any
text with a match. The index holds a posting (trigram, text) for every trigram that some query names,
taken from the lower-cased whole texts. A rule is tried only on texts whose postings fulfil its query,
and every candidate is verified with the expression itself. Rules without a mandatory trigram (runs of
hex digits) are tried on every text.

A private key goes from its BEGIN line to the next END line, if no other BEGIN line stands between. Without an END
line it goes on through header lines, blank lines and lines of base64, as many as there are, to the last line with a
word of 16 or more, and a short one and a line of check sum behind it; if there is no such line, nothing is found,
however the text goes on.

Spans are code points, the end exclusive. They follow from the lengths of the pieces between matches and
of the matches, summed up in order.

Defined cases: null text is searched as an empty one (and stays null when redacted); rows without doc_id
are searched like others; repeated rows give equal results; further columns are ignored by ``scan`` and
kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as codes
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters; ``base`` rules count for the digest.

    ``masked``: what ``redact`` replaces, if not the whole match; ``stays``: its groups that are left.
    ``first``: replaced before the others, which would cut it. ``key``: the match is the line ahead of a key.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    masked: str = ""
    stays: str = ""
    first: bool = False
    # The match begins a key that goes on behind it.
    key: bool = False


# The base kinds in their order, then well-known token formats.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12, True,
        masked=r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{12,}""",
        stays="$1",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True, masked=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, True, masked=r"[0-9a-f]{16,}"),
    # What belongs to a key is told by ``_key_length``.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----", first=True, key=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
# Strings that a part of an expression may stand for before it is taken for anything.
_MOST_STRINGS = 64

# A query is True (no condition), a trigram, or ("all" | "any", queries).
Query = bool | str | tuple


def _joined(how: str, parts: list[Query]) -> Query:
    if how == "any" and any(part is True for part in parts):
        return True
    parts = list(dict.fromkeys(part for part in parts if part is not True))
    if how == "any":
        # An alternative that asks for more than another adds nothing.
        asked = [_conjunction(part) for part in parts]
        parts = [part for part, own in zip(parts, asked) if not own or not any(other and other < own for other in asked)]
    return True if not parts else parts[0] if len(parts) == 1 else (how, tuple(parts))


def _conjunction(query: Query) -> set[str]:
    """The trigrams of a query without alternatives, else nothing."""
    if isinstance(query, str):
        return {query}
    return set(query[1]) if query[0] == "all" and all(isinstance(part, str) for part in query[1]) else set()


def _of_string(text: str) -> Query:
    return _joined("all", [text[i : i + 3] for i in range(len(text) - 2)])


def _strings(kind, value) -> set[str] | None:
    """All strings that a part can match, in lower case; None if they are many."""
    if kind is codes.LITERAL:
        return {chr(value).lower()}
    if kind is codes.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is codes.IN and all(k is codes.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if kind is codes.BRANCH:
        found = [_sequence_strings(branch) for branch in value[1]]
        return None if None in found else set().union(*found)
    if kind is codes.MAX_REPEAT and value[1] <= 4:
        inner = _sequence_strings(value[2])
        if inner is None:
            return None
        out, last = ({""} if value[0] == 0 else set()), {""}
        for times in range(1, value[1] + 1):
            last = {a + b for a in last for b in inner}
            out |= last if times >= value[0] else set()
        return out if len(out) <= _MOST_STRINGS else None
    return None


def _sequence_strings(parts) -> set[str] | None:
    out = {""}
    for kind, value in parts:
        found = _strings(kind, value)
        if found is None or len(out) * len(found) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _sequence_query(parts) -> Query:
    """Conditions of all parts; neighbours that stand for few strings are joined first."""
    queries: list[Query] = []
    held = {""}
    for kind, value in parts:
        found = _strings(kind, value)
        if found is not None and len(held) * len(found) <= _MOST_STRINGS:
            held = {a + b for a in held for b in found}
            continue
        queries.append(_joined("any", [_of_string(text) for text in sorted(held)]))
        held = {""} if found is None else found
        if found is None:
            queries.append(_part_query(kind, value))
    queries.append(_joined("any", [_of_string(text) for text in sorted(held)]))
    return _joined("all", queries)


def _part_query(kind, value) -> Query:
    if kind is codes.SUBPATTERN:
        return _sequence_query(value[-1])
    if kind is codes.BRANCH:
        return _joined("any", [_sequence_query(branch) for branch in value[1]])
    if kind is codes.MAX_REPEAT and value[0] >= 1:
        return _sequence_query(value[2])
    return True


def trigram_query(pattern: str) -> Query:
    """What trigrams any match must have, in lower case."""
    return _sequence_query(parser.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(trigrams_of, query[1]))


def _fulfilled(query: Query, grams: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(grams, query)
    out = _fulfilled(query[1][0], grams)
    for part in query[1][1:]:
        out = out & _fulfilled(part, grams) if query[0] == "all" else out | _fulfilled(part, grams)
    return out


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, text_key) of ``texts`` (text_key, text) for the trigrams given."""
    lowered = texts.select("text_key", F.lower("text").alias("lowered"))
    present = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(gram)), F.lit(gram)) for gram in trigrams]))
    return lowered.select("text_key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(text_key, kinds): the rules whose query the postings of a text fulfil. A text has few different trigrams."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = F.col("grams")
    kinds = F.array_compact(
        F.array(*[F.when(_fulfilled(q, grams), F.lit(kind)) for kind, q in queries.items() if q is not True])
    )
    gathered = index.groupBy("text_key").agg(F.collect_set("trigram").alias("grams"))
    return gathered.select("text_key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _with_kinds(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` has text_key and text; adds ``kinds``."""
    trigrams = sorted(set().union(*(trigrams_of(trigram_query(rule.pattern)) for rule in rules)))
    if not trigrams:
        return rows.withColumn("kinds", F.array().cast("array<string>"))
    found = candidates(build_index(rows.select("text_key", "text"), trigrams), rules)
    return rows.join(found, "text_key", "left")


def _to_try(rule: Rule) -> Column:
    if trigram_query(rule.pattern) is True:
        return F.lit(True)
    return F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))


# A line of a key file with its end, which may be written as a backslash and an n; what such lines can be; the end of a key.
KEY_LINE = r"[^\n\\]+(?:\\n|\n|\\)?|\\n|\n|\\"
KEY_BLANK = r"^[\x20\t\r]*(?:\\n|\n)?$"
KEY_HEADER = r"^[\x20\t]*[A-Za-z][A-Za-z0-9-]*:[^\n\\]*(?:\\n|\n)$"
KEY_BASE64 = r"^[A-Za-z0-9+/=\x20\t\r]*[A-Za-z0-9+/]{16}[A-Za-z0-9+/=\x20\t\r]*(?:\\n|\n|\\)?$"
# A short word with another one behind it: this is prose.
KEY_PROSE = r"(?:^|[\x20\t])[A-Za-z0-9+/=]{1,15}[\x20\t]+[A-Za-z0-9+/=]"
KEY_SHORT = r"^[\x20\t]*[A-Za-z0-9+/]{1,15}={0,2}[\x20\t\r]*(?:\\n|\n|\\)?$"
KEY_SUM = r"^[\x20\t]*=[A-Za-z0-9+/]{4}[\x20\t\r]*(?:\\n|\n|\\)?$"
KEY_LINE_END = r"[\x20\t\r]*(?:\\n|\n|\\)?$"
KEY_END = r"^[\x00-\x{10FFFF}]*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _key_length(rest: Column) -> Column:
    """How much of ``rest``, the text from behind a BEGIN line to the next one, belongs to the key."""
    def kind(line: Column) -> Column:
        return (
            F.when(line.rlike(KEY_BLANK) | line.rlike(KEY_HEADER), 0)
            .when(line.rlike(KEY_BASE64) & ~line.rlike(KEY_PROSE), 2)
            .when(line.rlike(KEY_SHORT), 1).when(line.rlike(KEY_SUM), 3).otherwise(-1)
        )

    def of_lines(lines: Column) -> Column:
        def of_kinds(kinds: Column) -> Column:
            other = F.array_position(kinds, F.lit(-1)).cast("int")
            known = F.when(other > 0, F.slice(kinds, 1, other - 1)).otherwise(kinds)
            back = F.array_position(F.reverse(known), F.lit(2)).cast("int")
            last = F.size(known) - back + 1
            for next_kind in (1, 3):
                last = F.when(F.get(known, last) == next_kind, last + 1).otherwise(last)
            body = F.aggregate(F.slice(lines, 1, last - 1), F.lit(0), lambda total, line: total + F.length(line))
            whole = body + F.length(F.regexp_replace(F.get(lines, last - 1), KEY_LINE_END, ""))
            return F.when(back > 0, whole).otherwise(0)

        return _let(F.transform(lines, kind), of_kinds)

    ended = F.length(F.regexp_extract(rest, KEY_END, 0))
    open_end = _let(F.regexp_extract_all(rest, F.lit(KEY_LINE), F.lit(0)), of_lines)
    return F.when(ended > 0, ended).otherwise(open_end)


def _key_parts(rule: Rule, use) -> Column:
    """``use(begins, pieces, lengths)``: the BEGIN lines, the text before, between and behind them, and how much of each piece
    belongs to the key whose line stands before it."""
    text = F.col("text")
    begins = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def of_pieces(pieces: Column) -> Column:
        rests = F.slice(pieces, 2, F.size(pieces))
        return _let(F.concat(F.array(F.lit(0)), F.transform(rests, _key_length)), lambda lengths: use(begins, pieces, lengths))

    return _let(F.split(text, rule.pattern, -1), of_pieces)


_HIT = "array<struct<kind:int,gap:int,size:int,ok:boolean>>"


def _hits(number: int, rule: Rule) -> Column:
    """Every match in order, with the length of what stands between it and the one before."""
    text = F.col("text")
    if rule.key:
        def of_parts(begins: Column, pieces: Column, lengths: Column) -> Column:
            gaps = F.zip_with(pieces, lengths, lambda piece, length: F.length(piece) - length)
            sizes = F.zip_with(begins, F.slice(lengths, 2, F.size(lengths)), lambda begin, length: F.struct(
                (F.length(begin) + length).alias("size"), (length > 0).alias("ok")))
            return F.zip_with(gaps, sizes, lambda gap, m: F.struct(
                F.lit(number).alias("kind"), gap.alias("gap"), m["size"].alias("size"), m["ok"].alias("ok"))).cast(_HIT)

        return F.when(_to_try(rule) & text.rlike(rule.pattern), _key_parts(rule, of_parts)).otherwise(F.array().cast(_HIT))
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    both = F.zip_with(found, tested, lambda m, g: F.struct(F.length(m).alias("size"), (F.length(g) >= rule.least).alias("ok")))
    rows = F.zip_with(
        gaps, both,
        lambda gap, m: F.struct(F.lit(number).alias("kind"), F.length(gap).alias("gap"), m["size"].alias("size"), m["ok"].alias("ok")),
    )
    return F.when(_to_try(rule) & text.rlike(rule.pattern), rows.cast(_HIT)).otherwise(F.array().cast(_HIT))


def find_spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, start, kind, end) of each span; ``texts`` has text_key and text; kind is the rule's number."""
    scanned = _with_kinds(texts, rules)
    hits = scanned.select(
        "text_key", F.posexplode(F.concat(*[_hits(number, rule) for number, rule in enumerate(rules)])).alias("place", "hit")
    )
    # Repeated rows have equal keys and equal hits.
    hits = hits.select("text_key", "place", "hit.*").filter("size IS NOT NULL").distinct()
    so_far = Window.partitionBy("text_key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return ends.filter("ok").select("text_key", (F.col("end") - F.col("size")).alias("start"), "kind", "end")


def _text_key() -> Column:
    """128 bits of doc_id and text: two texts never meet."""
    return F.struct(
        F.xxhash64("doc_id", "text").alias("one"), F.xxhash64(F.lit("other"), "text", "doc_id").alias("two")
    ).alias("text_key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        _text_key(),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, and the array ``found`` of (start, kind, end), by start and then kind."""
    rows = _keyed(docs)
    spans = find_spans(rows.select("text_key", "text"), rules)
    found = spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return (
        rows.select("doc_id", "text_key").join(found, "text_key", "left")
        .select("doc_id", F.coalesce("found", empty).alias("found"))
    )


def spans_text(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _without_keys(rule: Rule, mask: str) -> Column:
    def of_parts(begins: Column, pieces: Column, lengths: Column) -> Column:
        ends = F.zip_with(pieces, lengths, lambda piece, length: F.substr(piece, length + 1))
        heads = F.zip_with(begins, F.slice(lengths, 2, F.size(lengths)), lambda begin, length: F.when(length > 0, mask).otherwise(begin))
        # One head for each piece but the first.
        return F.concat(F.get(ends, F.lit(0)), F.array_join(F.zip_with(heads, F.slice(ends, 2, F.size(ends)), lambda head, end: F.concat(head, end)), ""))

    return F.when(F.col("text").rlike(rule.pattern), _key_parts(rule, of_parts)).otherwise(F.col("text"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mask`` in place of every secret in ``text``; the name before an assigned one stays."""
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col("text").cast("string").alias("text"),
        _text_key(),
    )
    masked = _with_kinds(rows, rules)
    # A step for each rule: as one nested expression the text before a rule would be worked out twice.
    for rule in sorted(rules, key=lambda rule: not rule.first):
        hidden = _without_keys(rule, mask) if rule.key else F.regexp_replace("text", rule.masked or rule.pattern, rule.stays + mask)
        masked = masked.withColumn("text", F.when(_to_try(rule), hidden).otherwise(F.col("text")))
    return masked.select(
        *[F.col("text") if name == "text" else F.col("row").getField(name).alias(name) for name in docs.columns]
    )
