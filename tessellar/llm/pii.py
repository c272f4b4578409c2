"""Personal data by candidate gradient boosting, with built-in functions only.

Four base kinds (e-mail, IP address, payment card, phone) are matched and validated by rule. Beside them, generators of
high recall propose overlapping candidates: values behind key words, long mixed tokens, account and identity numbers, local
phone numbers. Features of format and context describe a candidate, boosted trees score it as SQL CASE expressions, and a
calibrated threshold decides. The trees are trained here, on seeded synthetic sentences whose features the same
expressions compute. Base spans always stay; of the accepted candidates beside them the best is taken first, and each next one that overlaps none taken.

Positions are code points, ends exclusive. Null texts count as empty; repeated rows are searched row by row; an empty
table gives no rows; columns beside the text pass through. Patterns are rewritten so that no run of characters is scanned
twice and nothing recurses, however long a text is: the marks P1 and P2 stand for a point between host characters and for a
separator between digits, and are replaced in the text beforehand by the same number of code points.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

P1, P2 = "\ue000", "\ue001"
BASE = ("email", "ip", "card", "phone")
_PATTERNS = {
    # the original patterns' matches: a match starts where a run starts, or where the match before it ended
    "email": rf"(?:(?<![A-Za-z0-9._%+{P1}-])|\G)[A-Za-z0-9._%+{P1}-]++@[A-Za-z0-9-]++{P1}[A-Za-z0-9{P1}-]++",
    "ip": rf"(?<![0-9])[0-9]++{P1}[0-9]++{P1}[0-9]++{P1}[0-9]++",
    "card": rf"[0-9][0-9{P2}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_KEYWORD = "(?i:password|passwd|secret|token|apikey|api_key|api-key)"
#: Proposals; each must hold a digit, but for the values behind a key word.
GENERATORS = {
    "secret": rf"""(?<={_KEYWORD}["']?[\x20]{{0,2}}[:=][\x20]{{0,2}}["']?)[A-Za-z0-9_+/-]{{6,}}+""",
    "key": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9A-Za-z])[0-9]{9,19}(?![0-9A-Za-z])",
}
FEATURES = ("gen", "len", "digits", "upper", "hex", "context", "separators", "distinct", "luhn", "quoted")
_CONTEXT = r"(?i)(?:password|passwd|secret|token|key|ssn|social|iban|account|card|phone|tel|call|id|passport)[^A-Za-z0-9]{0,4}(?:is|no|nr)?[^A-Za-z0-9]{0,4}$"
_SPANS = "array<struct<start:int,end:int,m:string>>"
_ROWS = "array<struct<start:int,end:int," + ",".join(f"{k}:int" for k in FEATURES) + ">>"


def _found(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern with their positions: the text is split at them, and lengths add up."""
    quoted = "r'" + pattern.replace("'", r"\x27") + "'"
    parts, hits = f"split({text}, {quoted}, -1)", f"regexp_extract_all({text}, {quoted}, 0)"
    start = "struct(cast(array() as array<struct<start:int,end:int,m:string>>) as s, 0 as at)"
    step = "(a, x) -> struct(array_append(a.s, struct(a.at + length(x.p) as start, a.at + length(x.p) + length(x.h) as end, x.h as m)) as s, a.at + length(x.p) + length(x.h) as at)"
    return f"aggregate(zip_with(slice({parts}, 1, size({hits})), {hits}, (p, h) -> struct(p as p, h as h)), {start}, {step}, a -> a.s)"


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_email`, `_ip`, `_card` and `_phone`: the validated spans of each kind, in order."""
    none = f"cast(array() as {_SPANS})"
    t = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    t = t.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    t = t.withColumn("_keyed", F.col("_text").rlike(_KEYWORD + r"""["']?\x20{0,2}[:=]"""))
    t = t.withColumn("_clean", F.when(F.col("_digit") | F.col("_keyed") | F.col("_text").contains("@"), F.translate("_text", P1 + P2, "\ufffd\ufffd")))
    t = t.withColumn("_host", F.regexp_replace("_clean", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", P1))
    t = t.withColumn("_joined", F.when(F.col("_digit"), F.regexp_replace("_clean", r"(?<=[0-9])[\x20-](?=[0-9])", P2)))
    gate = {"email": "contains(_text, '@')", "ip": "_digit", "card": "_digit", "phone": "_digit and contains(_text, '+')"}
    source = {"email": "_host", "ip": "_host", "card": "_joined", "phone": "_clean"}
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    valid = {
        "email": "true",
        "ip": f"x.m rlike '^{_OCTET}{P1}{_OCTET}{P1}{_OCTET}{P1}{_OCTET}$'",
        "card": f"length({digits}) between 13 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 9 and 15",
    }
    return t.withColumns({f"_{k}": F.expr(f"case when {gate[k]} then filter({_found(source[k], _PATTERNS[k])}, x -> {valid[k]}) else {none} end") for k in BASE}).drop("_host", "_joined")


def with_candidates(base: DataFrame) -> DataFrame:
    """The frame of with_base, with `_candidates`: an array of structs of start, end, kind and FEATURES."""
    share = lambda keep: f"100 * length(regexp_replace(x.m, '[^{keep}]', '')) div length(x.m)"
    arrays = []
    for i, (name, pattern) in enumerate(GENERATORS.items()):
        before = "substring(_clean, greatest(x.start - 23, 1), least(x.start, 24))"
        fields = {
            "gen": str(i),
            "len": "length(x.m)",
            "digits": share("0-9"),
            "upper": share("A-Z"),
            "hex": share("0-9a-f"),
            "context": f"cast({before} rlike r'{_CONTEXT}' as int)",
            "separators": "length(regexp_replace(x.m, '[A-Za-z0-9]', ''))",
            "distinct": "size(array_distinct(split(x.m, '')))",
            "luhn": "cast(luhn_check(regexp_replace(x.m, '[^0-9]', '')) as int)",
            "quoted": f"cast({before} rlike r'[\"=:]$' as int)",
        }
        inner = ", ".join(f"cast({v} as int) as {k}" for k, v in fields.items())
        hits = _found("_clean", pattern)
        rows = f"transform({hits if name == 'secret' else f"filter({hits}, x -> x.m rlike '[0-9]')"}, x -> struct(x.start as start, x.end as end, {inner}))"
        arrays.append(f"case when {'_keyed' if name == 'secret' else '_digit'} then {rows} else cast(array() as {_ROWS}) end")
    return base.withColumn("_candidates", F.expr(f"case when _digit or _keyed then concat({', '.join(arrays)}) else cast(array() as {_ROWS}) end"))


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two: (feature, cut, left, right), a side being (feature, cut, low, high); sum + prior is a logit."""

    trees: tuple
    prior: float
    threshold: float

    def sql(self, of: str) -> str:
        leaf = lambda side: f"(case when {of}.{FEATURES[side[0]]} <= {side[1]} then {side[2]!r}d else {side[3]!r}d end)"
        return " + ".join([f"{self.prior!r}d", *[f"(case when {of}.{FEATURES[f]} <= {cut} then {leaf(a)} else {leaf(b)} end)" for f, cut, a, b in self.trees]])


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, tuple]:
    """The best split of a node: its gain and (feature, cut, value below, value above)."""
    value = lambda m: float(round(-0.3 * g[m].sum() / (h[m].sum() + 1.0), 6))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    everything = np.ones(len(x), bool)
    best = (0.0, (0, 0, value(everything), value(everything)))
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1].tolist():
            low = x[:, f] <= cut
            if (got := gain(low) + gain(~low) - gain(everything)) > best[0] + 1e-9:
                best = (got, (f, int(cut), value(low), value(~low)))
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 12) -> Trees:
    """Second-order boosting with logistic loss; the threshold is the lowest with a precision of 0.98 on every third row, held back."""
    back = np.arange(len(y)) % 3 == 2
    x1, y1 = x[~back], y[~back].astype(float)
    prior = float(round(np.log(y1.mean() / (1 - y1.mean())), 6))
    z, zb, trees = np.full(len(y1), prior), np.full(int(back.sum()), prior), []
    side = lambda s, q: np.where(q[:, s[0]] <= s[1], s[2], s[3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y1, p * (1 - p)
        f, cut, _, _ = _stump(x1, g, h)[1]
        low = x1[:, f] <= cut
        a, b = (_stump(x1[m], g[m], h[m])[1] if m.any() else (0, 0, 0.0, 0.0) for m in (low, ~low))
        trees.append((f, cut, a, b))
        z += np.where(low, side(a, x1), side(b, x1))
        zb += np.where(x[back][:, f] <= cut, side(a, x[back]), side(b, x[back]))
    order = np.argsort(-zb, kind="stable")
    precision = np.cumsum(y[back][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= 0.98)
    return Trees(tuple(trees), prior, float(round(zb[order[good[-1]]] - 1e-6, 6)) if len(good) else 99.0)


def synthetic(rows: int = 900, seed: int = 17) -> list[tuple[str, list[tuple[int, int]]]]:
    """Sentences with planted values to redact (their spans) and with harmless numbers, codes and hashes of versions."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    secret = [
        lambda: ("password=", pick("0123456789abcdef", rng.randint(12, 24)), ""),
        lambda: ('token = "', pick("0123456789abcdef", rng.choice([32, 40, 64])), '"'),
        lambda: ("secret: ", pick(lower + upper + digits, rng.randint(12, 40)), ""),
        lambda: ("api_key=", pick(lower + upper + digits, rng.randint(16, 200)), ""),
        lambda: (rng.choice(["password=", "PASSWORD=", "Secret="]), pick(lower, rng.randint(8, 20)), ""),
        lambda: ("", "AKIA" + pick(upper + digits, 16), ""),
        lambda: ("iban ", pick(upper, 2) + pick(digits, 18), ""),
        lambda: ("account ", pick(upper, 2) + pick(digits, 2) + pick(upper + digits, 18), ""),
        lambda: ("ssn ", f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", ""),
        lambda: ("", f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", ""),
        lambda: ("call ", f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", ""),
        lambda: ("tel: ", f"{pick(digits, 3)}.{pick(digits, 3)}.{pick(digits, 4)}", ""),
        lambda: ("account ", pick(digits, rng.randint(9, 14)), ""),
    ]
    harmless = [
        lambda: ("in ", pick(digits, rng.randint(9, 19)), ""),
        lambda: ("", pick(lower, rng.randint(14, 30)) + pick(digits, 1), ""),
        lambda: ("part ", pick(upper, 1) + pick(digits, 5), ""),
        lambda: ("total ", f"{pick(digits, 3)} {pick(digits, 3)} {pick(digits, 4)}", ""),
        lambda: ("", pick(upper, rng.randint(16, 24)) + pick(digits, 1), ""),
        lambda: ("page=", pick(digits, rng.randint(6, 8)), ""),
        lambda: (rng.choice(["the secret: ", "a token: ", "password : "]), pick(lower, rng.randint(6, 9)), ""),
    ]
    out = []
    for i in range(rows):
        before, value, after = rng.choice(secret if i % 2 else harmless)()
        start = " ".join(pick(lower, rng.randint(2, 9)) for _ in range(rng.randint(1, 6))) + " "
        text = start + before + value + after + " " + pick(lower, 6)
        at = len(start) + len(before)
        out.append((text, [(at, at + len(value))] if i % 2 else []))
    return out


_TRAINED: dict[int, Trees] = {}


def trees(spark: SparkSession, rounds: int = 12) -> Trees:
    """The trained trees; fitted once in a process, from the synthetic sentences' candidates."""
    if rounds not in _TRAINED:
        rows = spark.createDataFrame(synthetic(), "text string, planted array<struct<a:int,b:int>>").coalesce(1)
        found = with_candidates(with_base(rows)).selectExpr("planted", "inline(_candidates)").collect()
        # right: at least half of the planted value, and no more than half again beyond it
        near = lambda r: any(2 * (min(r["end"], s.b) - max(r["start"], s.a)) >= max(s.b - s.a, (r["end"] - r["start"]) * 2 // 3) for s in r["planted"])
        _TRAINED[rounds] = boost(np.array([[r[k] for k in FEATURES] for r in found]), np.array([near(r) for r in found]), rounds)
    return _TRAINED[rounds]


def find(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """docs with `base` and `found`: arrays of struct(kind, start, end), base spans by kind as listed and then start, found with the method's behind them."""
    out = with_candidates(with_base(docs, text))
    base = ", ".join(f"transform(_{k}, x -> struct('{k}' as kind, x.start as start, x.end as end))" for k in BASE)
    out = out.withColumn("base", F.expr(f"concat({base})"))
    names = "array(" + ", ".join(f"'{k}'" for k in GENERATORS) + ")"
    scored = f"filter(transform(_candidates, x -> struct({names}[x.gen] as kind, x.start as start, x.end as end, {model.sql('x')} as z)), x -> x.z > {model.threshold!r}d)"
    out = out.withColumn("_scored", F.expr(f"case when size(_candidates) > 0 then {scored} else cast(array() as array<struct<kind:string,start:int,end:int,z:double>>) end"))
    meets = "y.start < x.end and x.start < y.end"
    better = "(y.z > x.z or (y.z = x.z and (y.start < x.start or (y.start = x.start and (y.end > x.end or (y.end = x.end and y.kind < x.kind))))))"
    best_first = f"array_sort(filter(_scored, x -> not exists(base, y -> {meets})), (y, x) -> case when {better} then -1 when y.z = x.z and y.start = x.start and y.end = x.end and y.kind = x.kind then 0 else 1 end)"
    own = f"aggregate({best_first}, cast(array() as array<struct<kind:string,start:int,end:int,z:double>>), (a, x) -> case when exists(a, y -> {meets}) then a else array_append(a, x) end)"
    out = out.withColumn("found", F.expr(f"concat(base, transform(array_sort({own}, (l, r) -> case when l.start < r.start then -1 when l.start > r.start then 1 else 0 end), x -> struct(x.kind as kind, x.start as start, x.end as end)))"))
    return out.drop("_text", "_digit", "_keyed", "_clean", "_candidates", "_scored", *[f"_{k}" for k in BASE])


def told(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """docs with every span found replaced by its kind in brackets; overlapping spans are one, named by the first. Null texts stay null."""
    # the input's columns travel as one, so that none clashes with the spans' names
    out = find(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_t")), model, "_t")
    order = "array_sort(found, (l, r) -> case when l.start < r.start then -1 when l.start > r.start then 1 when l.end > r.end then -1 when l.end < r.end then 1 else 0 end)"
    last = "element_at(a, -1)"
    grown = f"concat(slice(a, 1, size(a) - 1), array(struct({last}.kind as kind, {last}.start as start, greatest({last}.end, x.end) as end)))"
    merged = f"aggregate({order}, cast(array() as array<struct<kind:string,start:int,end:int>>), (a, x) -> case when size(a) > 0 and {last}.end > x.start then {grown} else array_append(a, x) end)"
    out = out.withColumn("_merged", F.expr(f"case when size(found) > 0 then {merged} end"))
    pieces = f"transform(_merged, (x, i) -> concat(substring(_t, case when i = 0 then 1 else _merged[i - 1].end + 1 end, x.start - case when i = 0 then 0 else _merged[i - 1].end end), '[', upper(x.kind), ']'))"
    rest = "substring(_t, element_at(_merged, -1).end + 1, length(_t))"
    redacted = F.expr(f"case when _merged is null then _t else concat(array_join({pieces}, ''), {rest}) end")
    return out.select(*[(redacted if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
