"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from broad patterns, placed by the text between matches
in one pass, so cost grows with a text's length, not with its square. Three
labelers vote on each: a strict pattern (form, checksums, ranges), a gazetteer
(issuer digits, country and area codes, top-level domains, address ranges) and
the context (a cue word before it, or a clash with the characters beside it). Votes and features have few
values, so all candidates of the corpus are counted into a table of bounded
size. Expectation-maximisation on it estimates each labeler's reliability for
each kind and every vote pattern's probability; with these as soft labels, a
naive Bayes classifier over span features is trained, and its verdict and the
votes' decide. Spans of the base patterns always stay.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
PASSES = 25
#: Posterior probability from which a candidate beyond the base patterns is a span.
ACCEPTED = 0.5

# Patterns. Possessive repeats and the guard before a run keep them linear;
# they match what the plain forms match, as no repeat can give back a character that helps.
# A card's run of digits starts where no digit is joined to it, and shorter runs are left out.
# Repeated groups take one character with a look-ahead: others would recurse once for each repeat.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?=\.?[A-Za-z0-9-])[A-Za-z0-9.-])*+"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])(?=[0-9 -]{12})[0-9](?:(?=[ -]?[0-9])[0-9 -])*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+(.-])(?<!\+[0-9] |\+[0-9]{2} )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SECRET = r"(?i)(?<![a-z0-9_])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)[\"']? ?[=:] ?[\"'][A-Za-z0-9+/_.-]{16,200}[\"']"
# Gazetteers and cue words.
DOMAINS = r"\.(?:com|org|net|edu|gov|io|info|biz|int|mil|co|eu|de|fr|es|uk|us|ca|at|ch|it|nl|be|pt|pl|br|mx|ar|au|in|jp|cn|ru)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CUES = (
    r"(?i)(?:e-?mail|contact|courriel|correo|write to)\W*$",
    r"(?i)(?:\bip\b|address|host|server|from)\W*$",
    r"(?i)(?:card|visa|mastercard|amex|payment|tarjeta|carte|karte|account|credit)\W*$",
    r"(?i)(?:phone|tel|call|mobile|fax|t[ée]l|tel[ée]fono|telefon|cell)\W*$",
    r"(?:^|[\s{(,;\x22\x27])$",
)


#: Any cue word nearby: a feature of the final classifier.
NEARBY = r"(?i)mail|contact|\bip\b|address|host|server|card|visa|payment|account|phone|tel|call|mobile|fax|key|token|secret|passw"


def _found(pattern: str, guard: str) -> Column:
    """All matches; a text without the guard has none."""
    return F.when(F.contains(F.col("t"), F.lit(guard)), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


#: Array elements that a running value takes one by one; blocks of so many keep its cost from growing with their square.
RUN = 128
#: Characters of a segment of the text, from which masking takes its pieces.
SEGMENT = 1024


def _running(values: str, merge: str) -> str:
    """SQL of the running value of an int array under an associative merge of a and x that has 0 as its neutral element."""
    step = merge.format(a="coalesce(try_element_at(r, -1), 0)", x="v")
    one = "aggregate({v}, cast(array() as array<int>), (r, v) -> array_append(r, {step}))".format(v="{v}", step=step)
    ran = f"transform(sequence(0, (size({values}) - 1) div {RUN}), j -> {one.format(v=f'slice({values}, j * {RUN} + 1, {RUN})')})"
    total = merge.format(a="element_at(r, -1)", x="element_at(b, -1)")
    added = merge.format(a="f", x="v")
    # Each block's running values, then what all blocks before it add.
    blocks = f"transform(array({ran}), w -> flatten(zip_with(w, slice(aggregate(w, array(0), (r, b) -> array_append(r, {total})), 1, size(w)), (b, f) -> transform(b, v -> {added}))))[0]"
    return f"if(size({values}) <= {RUN}, {one.format(v=values)}, {blocks})"


#: Matches with their places, from the text between them: split by the same pattern, in one pass over the text.
#: before and after: the text beside a match, as far as the match of its kind before it and after it.
_PLACED = """transform({m}, (m, i) -> named_struct('start', {e}[i] - char_length(m), 'end', {e}[i], 'm', m,
 'before', right(concat(if(i > 0, {m}[i - 1], ''), {b}[i]), 24), 'after', left(concat({b}[i + 1], coalesce(get({m}, i + 1), '')), 1)))"""

_DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(sequence(1, char_length({_DIGITS})), i -> if(i % 2 = 1, cast(substring(reverse({_DIGITS}), i, 1) as int),"
    f" (2 * cast(substring(reverse({_DIGITS}), i, 1) as int)) % 10 + cast((2 * cast(substring(reverse({_DIGITS}), i, 1) as int)) div 10 as int))), 0, (a, x) -> a + x) % 10 = 0"
)
#: What makes a match a base span.
_BASE = (
    "true",
    "forall(split(s.m, '[.]'), x -> coalesce(try_cast(x as bigint) <= 255, false))",
    f"(if(char_length({_DIGITS}) between 12 and 19, {_LUHN}, false))",
    f"char_length({_DIGITS}) between 9 and 15",
    "false",
)
#: What a candidate that is no base span must look like.
_WIDE = ("false", "false", f"char_length({_DIGITS}) between 13 and 19 and s.m rlike r'^(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\\1[0-9]{{4}}\\1[0-9]{{1,7}})$'", "false", "true")
#: First labeler, by kind and for phone numbers without a country code: a strict pattern.
_STRICT = (
    r"char_length(s.m) <= 254 and s.m rlike r'^[A-Za-z0-9](?:[A-Za-z0-9_+-]|[.](?![.@]))*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?[.])+[A-Za-z]{2,}$'",
    "s.m rlike r'^(?:0|[1-9][0-9]*)(?:[.](?:0|[1-9][0-9]*)){3}$'",
    f"(if(char_length({_DIGITS}) between 13 and 19, {_LUHN}, false))",
    r"s.m rlike r'^[+][0-9]{1,3}(?:([ .-])[(]?[0-9]{1,4}[)]?(?:\1[0-9]{2,6}){1,4}|[0-9]{7,12})$'",
    r"s.m rlike r'[\x22\x27](?:[A-Za-z0-9_-]{20,}|[A-Za-z0-9+/]{24,}={0,2})[\x22\x27]$'",
    r"s.m rlike r'^(?:[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|[(][0-9]{3}[)] [0-9]{3}-[0-9]{4})$'",
)
#: Second labeler: gazetteers.
_LISTED = (
    f"lower(s.m) rlike r'{DOMAINS}'",
    "try_cast(split_part(s.m, '.', 1) as bigint) between 1 and 223",
    f"{_DIGITS} rlike r'{ISSUERS}'",
    f"s.m rlike r'{COUNTRIES}'",
    "s.m rlike '[0-9]' and s.m rlike '[A-Za-z]' and not lower(s.m) rlike r'example|sample|placeholder|changeme|your[_-]'",
    "s.m rlike '^[(]?[2-9](?!11)[0-9]{2}[) .-]+[2-9]'",
)
NEAR = len(KINDS)


def _candidates(kind: int, source: str, rules: int) -> str:
    """Spans of a kind with votes and features, from placed matches; rules: whose labelers vote."""
    clash = "(s.before rlike '[A-Za-z0-9_/=.-]$' or s.after rlike '^[A-Za-z0-9_/=@-]')"
    edge = lambda x, at: f"case when {x} = '' or {x} rlike r'{at[0]}\\s{at[1]}' then 0 when {x} rlike '{at[0]}[A-Za-z0-9]{at[1]}' then 2 else 1 end"
    fields = {
        "start": "s.start",
        "kind": str(kind),
        "end": "s.end",
        "base": _BASE[kind] if rules < NEAR else "false",
        "strict": f"if({_STRICT[rules]}, 1, -1)",
        "listed": f"if({_LISTED[rules]}, 1, -1)",
        "context": f"case when s.before rlike r'{CUES[kind]}' then 1 when {clash} then -1 else 0 end",
        "left": edge("s.before", ("", "$")),
        "right": edge("s.after", ("^", "")),
        "size": "cast(least(7, floor(log2(s.end - s.start))) as int)",
        "cue": f"if(s.before rlike r'{NEARBY}', 1, 0)",
        "shape": "if(s.m rlike '[A-Z]', 1, 0) + if(s.m rlike '[ ()]', 2, 0)",
    }
    struct = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    kept = f"filter({source}, s -> ({_BASE[kind]}) or ({_WIDE[kind]}))" if rules < NEAR else source
    return f"transform({kept}, s -> {struct})"


def spans_with_votes(docs: DataFrame) -> DataFrame:
    """row (the document's columns in a struct) and found: all candidate spans by place.

    The input's columns stay inside row, so no name of theirs can clash with the columns made here.
    """
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("t", F.coalesce("row.text", F.lit("")))
    sources = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, ""), "phone": (PHONE, "+"), "secret": (SECRET, ""), "near": (LOCAL_PHONE, "")}
    df = df.withColumns({f"m_{k}": _found(pattern, guard) for k, (pattern, guard) in sources.items()})
    none = F.array().cast("array<string>")
    df = df.withColumns({f"b_{k}": F.when(F.size(f"m_{k}") > 0, F.split("t", pattern, -1)).otherwise(none) for k, (pattern, _) in sources.items()})
    df = df.withColumns({f"n_{k}": F.expr(f"transform(m_{k}, (m, i) -> char_length(b_{k}[i]) + char_length(m))") for k in sources})
    df = df.withColumns({f"e_{k}": F.expr(_running(f"n_{k}", "{a} + {x}")) for k in sources})
    df = df.withColumns({k: F.expr(_PLACED.format(m=f"m_{k}", b=f"b_{k}", e=f"e_{k}")) for k in sources})
    parts = [_candidates(i, k, i) for i, k in enumerate(KINDS)] + [_candidates(KINDS.index("phone"), "near", NEAR)]
    return df.select("row", F.expr(f"array_sort(concat({', '.join(parts)}))").alias("found"))


VOTES = ("strict", "listed", "context")
FEATURES = ("left", "right", "size", "cue", "shape")


def reliabilities(rows: list[dict]) -> tuple[dict, dict]:
    """Expectation-maximisation over the table of vote patterns.

    Returns the posterior of each (kind, votes), and for each kind, labeler and
    class how likely each vote is. Votes for start out right more often than
    not; a kind without candidates has no entry.
    """
    counts: dict[int, dict[tuple, float]] = defaultdict(lambda: defaultdict(float))
    for r in rows:
        counts[r["kind"]][tuple(r[v] for v in VOTES)] += r["n"]
    posterior, rates = {}, {}
    for kind, patterns in counts.items():
        share = 0.5
        rate = {(i, c): {v: (0.2 if v == 0 else 0.6 if (v > 0) == bool(c) else 0.2) for v in (-1, 0, 1)} for i in range(len(VOTES)) for c in (0, 1)}
        for _ in range(PASSES):
            p = {}
            for votes in patterns:
                odds = [math.log(share if c else 1 - share) + sum(math.log(rate[i, c][v]) for i, v in enumerate(votes)) for c in (0, 1)]
                p[votes] = 1 / (1 + math.exp(min(50.0, odds[0] - odds[1])))
            total = sum(patterns.values())
            share = min(0.99, max(0.01, sum(n * p[v] for v, n in patterns.items()) / total))
            for i in range(len(VOTES)):
                for c in (0, 1):
                    weight = {x: 2.0 * (0.6 if (x > 0) == bool(c) and x else 0.2) for x in (-1, 0, 1)}
                    for votes, n in patterns.items():
                        weight[votes[i]] += n * (p[votes] if c else 1 - p[votes])
                    rate[i, c] = {x: w / sum(weight.values()) for x, w in weight.items()}
        posterior |= {(kind, *v): x for v, x in p.items()}
        rates |= {(kind, i, c): r for (i, c), r in rate.items()}
    return posterior, rates


def decisions(rows: list[dict]) -> list[int]:
    """Codes of the patterns that the final classifier accepts."""
    posterior, _ = reliabilities(rows)
    weight: dict[tuple, float] = defaultdict(lambda: 1.0)
    for r in rows:
        p = posterior[(r["kind"], *(r[v] for v in VOTES))]
        for c, w in ((1, p), (0, 1 - p)):
            weight[r["kind"], c] += w * r["n"]
            for f in FEATURES:
                weight[r["kind"], c, f, r[f]] += w * r["n"]
    out = []
    for r in rows:
        p = min(1 - 1e-9, max(1e-9, posterior[(r["kind"], *(r[v] for v in VOTES))]))
        odds = math.log(p / (1 - p))
        for f in FEATURES:
            odds += math.log(weight[r["kind"], 1, f, r[f]] / weight[r["kind"], 1]) - math.log(weight[r["kind"], 0, f, r[f]] / weight[r["kind"], 0])
        if 1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))) >= ACCEPTED:
            out.append(r["code"])
    return sorted(set(out))


#: A candidate's kind, votes and features as one number.
_CODE = "((((((((s.kind * 3 + s.strict + 1) * 3 + s.listed + 1) * 3 + s.context + 1) * 3 + s.left) * 3 + s.right) * 8 + s.size) * 2 + s.cue) * 4 + s.shape)"


def _accepted(found: DataFrame) -> Column:
    """The spans that stay: base ones, and candidates whose pattern the classifier accepts."""
    s = found.select(F.explode("found").alias("s"))
    table = s.groupBy(F.expr(_CODE).alias("code"), *(F.col(f"s.{x}").alias(x) for x in ("kind", *VOTES, *FEATURES))).agg(F.count(F.lit(1)).alias("n"))
    # A row for each pattern: 5 kinds, 27 votes, 576 features at most.
    codes = decisions([r.asDict() for r in table.orderBy("code").collect()])
    listed = f"array_contains(array({', '.join(map(str, codes))}), {_CODE})" if codes else "false"
    return F.expr(f"filter(found, s -> s.base or {listed})")


_SHOWN = "array_join(transform({a}, s -> concat_ws(':', element_at(array({k}), s.kind + 1), s.start, s.end)), ',')"


def shown(spans: str) -> Column:
    return F.expr(_SHOWN.format(a=spans, k=", ".join(f"'{k}'" for k in KINDS)))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans.

    Null and empty texts have no spans. Repeated rows give repeated results and
    count as often in the votes; other columns are not read; an empty table
    gives no rows.
    """
    found = staged(spans_with_votes(docs.select("doc_id", "text")).select("row.doc_id", "found"), "pii-found")
    out = found.withColumn("kept", _accepted(found)).withColumn("own", F.expr("filter(found, s -> s.base)"))
    count = lambda k: F.expr(f"cast(size(filter(own, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *(count(k) for k in range(BASE_KINDS)), F.sha2(shown("own"), 256).alias("base_sha256"), shown("kept").alias("spans"))


#: Text from place a to place b, from the segments they lie in.
_PIECE = f"if({{b}} <= {{a}}, '', substring(array_join(slice(segments, {{a}} div {SEGMENT} + 1, ({{b}} - 1) div {SEGMENT} - {{a}} div {SEGMENT} + 1), ''), {{a}} % {SEGMENT} + 1, {{b}} - {{a}}))"


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars to match if there is one.

    Of spans that overlap the first is named; the others only widen it. Null
    and empty texts stay as they are, and so do texts without spans and every
    other column, whatever its name. Repeated rows stay repeated and count as
    often in the votes; an empty table gives no rows.
    """
    found = staged(spans_with_votes(docs), "pii-found")
    df = found.withColumn("kept", _accepted(found)).withColumn("ends", F.expr("transform(kept, s -> s.end)"))
    some = F.size("kept") > 0
    df = df.withColumn("covered", F.when(some, F.expr(_running("ends", "greatest({a}, {x})"))))
    df = df.withColumn("segments", F.when(some, F.regexp_extract_all("row.text", F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))))
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    before = "if(i = 0, 0, covered[i - 1])"
    named = f"transform(kept, (s, i) -> if(s.start < {before}, '', concat({_PIECE.format(a=before, b='s.start')}, element_at(array({kinds}), s.kind + 1))))"
    rest = _PIECE.format(a="element_at(covered, -1)", b="char_length(row.text)")
    df = df.withColumn("masked", F.when(some, F.expr(f"concat(array_join({named}, ''), {rest})")).otherwise(F.col("row.text")))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in out:
        out["n_chars"] = F.when(some, F.char_length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return df.select(*(x.alias(c) for c, x in out.items()))
