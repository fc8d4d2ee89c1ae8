"""Personal data: overlapping candidate spans, boosted trees over format and context, thresholds.

Everything runs as DataFrame expressions. Generators with high recall propose spans of several
kinds; their positions come from splitting the text by the generator's pattern. Each candidate is a
set of yes-or-no features of its form and its surroundings. The trees learn from texts of known
content (``examples``): made-up personal data in usual contexts, and look-alikes such as settings,
part numbers, times and place-holders in theirs. Candidates of these texts are counted by kind and
features, at most ``len(KINDS) * 2 ** len(FEATURES)`` cells, and boosting over the counts equals
boosting over all candidates. A third of the examples is held out: on it each kind's threshold is
set, the least score from which candidates are precise enough. The trees become a SQL expression.

Base spans, those that the contract defines, always stay. A further candidate stays if it meets its
kind's full rule (formats, checksums) or reaches its kind's threshold. The model is the same for any
corpus, so what is reported of a text doesn't depend on the texts beside it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import replace_columns, table, text_or_empty

_LOCAL = "A-Za-z0-9._%+-"
#: Base kinds in their order: cheap test and pattern. Possessive and anchored to the start of a run
#: or the end of the last match, so they match what the contract's patterns match in linear time.
BASE = {
    "email": (r"@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Further candidates: cheap test, pattern, and the full rule that labels them.
EXTRA = {
    "secret": (
        r"(?i)token|secret|passw|api.?key|private.?key|access.?key",
        r"(?i)(?:token|secret|passw(?:or)?d|(?:api|access|private)[_-]?key)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9_+/.=-]{5,}+[\"']?",
        r"(?i)^[^=:]*[=:]\x20*[\"']?(?=[A-Za-z0-9_+/.=-]*[0-9])(?=[A-Za-z0-9_+/.=-]*[a-z])[A-Za-z0-9_+/.=-]{16,}[\"']?$",
    ),
    "key": (
        r"AKIA|ghp_|xox[abp]-|BEGIN [A-Z ]*PRIVATE KEY",
        r"(?:AKIA[0-9A-Z]{12,20}+|ghp_[A-Za-z0-9]{20,}+|xox[abp]-[A-Za-z0-9-]{10,}+|-----BEGIN [A-Z ]*PRIVATE KEY-----)",
        r"^(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[abp]-[0-9]{6,}-[A-Za-z0-9-]+|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)$",
    ),
    "iban": (
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"^(?:DE[0-9]{20}|FR[0-9]{12}[0-9A-Z]{11}[0-9]{2}|ES[0-9]{22}|GB[0-9]{2}[A-Z]{4}[0-9]{14}|NL[0-9]{2}[A-Z]{4}[0-9]{10}|IT[0-9]{2}[A-Z][0-9]{10}[0-9A-Z]{12}|AT[0-9]{18}|BE[0-9]{14}|CH[0-9]{7}[0-9A-Z]{12})$",
    ),
    "ssn": (
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    ),
    "masked_email": (
        r"(?i)[\[(]\x20?at\x20?[\])]",
        rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]++)++",
        r"(?i)^[a-z0-9][a-z0-9._%+-]*\x20?[\[(]\x20?at.*[a-z]{2,24}$",
    ),
    "mac": (
        r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]",
        r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])",
        r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}$|^[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}$",
    ),
}
KINDS = [*BASE, *EXTRA]

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_CUES = r"(?i)mail|phone|tel|mobil|fax|call|card|visa|iban|account|konto|ssn|social|token|secret|key|passw|auth|login|server|host|addr"

#: SQL over a candidate c (start, end, hit, before, after): format and context, never the full rule.
FEATURES = {
    "cue": f"c.before rlike '{_CUES}'",
    "glued_left": "c.before rlike '[A-Za-z0-9]$'",
    "glued_right": "c.after rlike '^[A-Za-z0-9]'",
    "digits": "c.hit rlike '[0-9]'",
    "letters": "c.hit rlike '[A-Za-z]'",
    "long": "length(c.hit) >= 20",
    "very_long": "length(c.hit) >= 36",
    "quoted": "c.hit rlike '[\"\\']'",
    "spaced": "c.hit rlike '[\\\\x20()-]'",
    "letter_end": "c.hit rlike '[A-Za-z]{2}[\"\\']?$'",
    "word": "c.hit rlike '[=:]\\x20*[\"\\']?(?:[a-z]+|[A-Z][a-z]+|[A-Z]+|[a-z]+[._-][A-Za-z._-]+|[a-z]+[A-Z][A-Za-z]+)[\"\\']?$'",
    "varied": "size(array_distinct(split(c.hit, ''))) >= 10",
    "number_cue": "c.before rlike '(?i)(?:no|nr|ref|part|order|item|model|version|at|from)[.:#]?\\x20*$'",
}

ROUNDS = 20
SHRINK = 0.3
#: Least share of true candidates above a threshold, on held-out examples.
PRECISION = 0.95
#: Examples that are made of each line of ``EXAMPLES``.
EACH = 60

#: Added to the score of a candidate that meets its full rule; scores stay far below it.
VALID = 1e6

#: Kind, whether it is personal, what stands before, SQL of the value, what stands after. Values come from hashes of
#: the row: hex (16 lower-case hexadecimal digits), digits (18), letters (18 capitals) and word (of some settings).
EXAMPLES = [
    ("secret", True, "password: ", "concat(substring(lower(letters), 1, 4), substring(digits, 1, 4))", " for the login"),
    ("secret", True, "my passwd = '", "concat(substring(letters, 1, 1), substring(lower(letters), 2, 4), substring(digits, 1, 2))", "' do not share"),
    ("secret", True, "api_key=", "substring(hex, 1, 12)", "\\nhost=db"),
    ("secret", True, '{"token": "', "concat(substring(letters, 1, 5), substring(hex, 1, 9))", '"}'),
    ("secret", True, "private-key: ", "concat(hex, substring(letters, 1, 3))", ""),
    ("secret", True, "secret = ", "substring(digits, 1, 9)", ", keep it safe"),
    ("secret", False, "password: ", "word", " in this form"),
    ("secret", False, "token = ", "concat(word, '_', word)", "\\nreturn token"),
    ("secret", False, "secret: ", "concat(word, '.', word)", ";"),
    ("secret", False, "api_key = '", "concat('your-', word, '-here')", "'"),
    ("secret", False, "access_key=", "concat('get', initcap(word), 'Key')", "()"),
    ("secret", False, "every token: ", "initcap(word)", " is split at blanks"),
    ("key", True, "key id ", "concat('AKIA', substring(letters, 1, 9), substring(digits, 1, 6))", " was found"),
    ("key", True, "export GH=", "concat('ghp_', hex, substring(hex, 1, 9))", ""),
    ("key", True, "bot ", "concat('xoxb-', substring(digits, 1, 5), '-', hex)", ""),
    ("key", False, "such as ", "concat('AKIA', repeat('X', 12))", " in the manual"),
    ("key", False, "GH=", "concat('ghp_', repeat('x', 24))", " # replace"),
    ("key", False, "set ", "concat('xoxb-your-', word, '-', word)", ""),
    ("iban", True, "account ", "concat('PL', substring(digits, 1, 2), ' ', substring(digits, 3, 4), ' ', substring(digits, 7, 4), ' ', substring(digits, 11, 4), ' ', substring(digits, 1, 4), ' ', substring(digits, 5, 4), ' ', substring(digits, 9, 4))", ""),
    ("iban", True, "IBAN: ", "concat('SE', digits, substring(digits, 1, 4))", " at the bank"),
    ("iban", False, "order ", "concat(substring(letters, 1, 2), substring(digits, 1, 2), ' ', substring(letters, 3, 4), ' ', substring(letters, 7, 4))", " was sent"),
    ("iban", False, "model ", "concat(substring(letters, 1, 2), substring(digits, 1, 2), substring(letters, 3, 4), substring(digits, 3, 4))", ""),
    ("ssn", True, "social security ", "concat('9', substring(digits, 1, 2), '-', substring(digits, 3, 2), '-', substring(digits, 5, 4))", " on file"),
    ("ssn", False, "part ", "concat('000-', substring(digits, 3, 2), '-', substring(digits, 5, 4))", " in stock"),
    ("ssn", False, "item no. ", "concat('9', substring(digits, 1, 2), '-', substring(digits, 3, 2), '-0000')", ""),
    ("masked_email", True, "mail me: ", "concat(lower(substring(letters, 1, 5)), substring(digits, 1, 2), ' (at) ', lower(substring(letters, 6, 5)), ' (dot) ', substring(digits, 1, 1), 'x1')", ""),
    ("masked_email", True, "mail -", "concat(lower(substring(letters, 1, 5)), '[at]', lower(substring(letters, 6, 5)), '[dot]com')", ""),
    ("masked_email", False, "the score of ", "concat('+', substring(digits, 1, 2), ' (at) ', substring(digits, 3, 2), '.', substring(digits, 5, 2))", ""),
    ("masked_email", False, "fare ", "concat('.', substring(digits, 1, 2), ' [at] ', substring(digits, 3, 2), '.', substring(digits, 5, 1))", " each"),
    ("mac", True, "hardware addr ", "concat_ws(':', substring(hex, 1, 2), substring(hex, 3, 2), concat('a', substring(digits, 1, 1), '-b', substring(digits, 2, 1)), substring(hex, 7, 2), concat('f', substring(digits, 5, 1)))", ""),
    ("mac", False, "from ", "concat_ws(':', substring(digits, 1, 2), substring(digits, 3, 2), concat(substring(digits, 5, 2), '-', substring(digits, 7, 2)), substring(digits, 9, 2), substring(digits, 11, 2))", " on"),
]
_WORDS = "required optional undefined string default maximum example placeholder none hidden changeme value".split()

OUTPUTS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _candidates(text: str, kind: str, gate: str, pattern: str) -> Column:
    """All matches of a generator as an array of structs, empty unless the cheap test passes."""
    p = _quote(pattern)
    # a split by the pattern gives what lies between the matches
    return F.expr(
        f"""CASE WHEN {text} rlike {_quote(gate)} THEN
        aggregate(
            arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)),
            named_struct('at', 0, 'found', cast(array() as array<struct<start: int, end: int, hit: string>>)),
            (a, x) -> CASE WHEN x.`1` IS NULL THEN a ELSE named_struct(
                'at', a.at + length(x.`0`) + length(x.`1`),
                'found', concat(a.found, array(named_struct('start', a.at + length(x.`0`),
                    'end', a.at + length(x.`0`) + length(x.`1`), 'hit', x.`1`)))) END,
            a -> transform(a.found, c -> named_struct('kind', {_quote(kind)}, 'start', c.start, 'end', c.end,
                'hit', c.hit, 'before', substring({text}, greatest(c.start - 31, 1), least(c.start, 32)),
                'after', substring({text}, c.end + 1, 4))))
        ELSE cast(array() as array<struct<kind: string, start: int, end: int, hit: string, before: string, after: string>>) END"""
    )


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


#: SQL of the full rules over a candidate c.
RULES = {
    "email": "true",
    "ip": f"c.hit rlike {_quote(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}",
    "card": f"length({_digits('c.hit')}) BETWEEN 16 AND 19 AND luhn_check({_digits('c.hit')})",
    "phone": f"length({_digits('c.hit')}) BETWEEN 8 AND 15",
    **{kind: f"replace(c.hit, ' ', '') rlike {_quote(rule)}" if kind == "iban" else f"c.hit rlike {_quote(rule)}" for kind, (_, _, rule) in EXTRA.items()},
}


@dataclass
class Tree:
    """Two questions deep: a feature, then one on either side, and four values."""

    root: int
    sides: tuple[int, int]
    values: tuple[tuple[float, float], tuple[float, float]]

    def score(self, bits: tuple[bool, ...]) -> float:
        side = int(bits[self.root])
        return self.values[side][int(bits[self.sides[side]])]


@dataclass
class Model:
    """Boosted trees over the bits of KINDS and FEATURES, and the threshold of each kind."""

    bias: float
    trees: list[Tree]
    thresholds: dict[str, float]

    def score(self, bits: tuple[bool, ...]) -> float:
        return self.bias + sum(t.score(bits) for t in self.trees)

    def sql(self, kind: str) -> str:
        """The score of a candidate c of that kind; questions about the kind are answered here."""
        names = list(FEATURES.values())

        def ask(bit: int, yes: str, no: str) -> str:
            if bit < len(KINDS):
                return yes if KINDS[bit] == kind else no
            return yes if yes == no else f"IF({names[bit - len(KINDS)]}, {yes}, {no})"

        parts = [ask(t.root, *(ask(t.sides[s], f"{t.values[s][1]!r}D", f"{t.values[s][0]!r}D") for s in (1, 0))) for t in self.trees]
        return " + ".join([f"{self.bias!r}D", *parts])


Cell = tuple[tuple[bool, ...], int, int]


def boost(cells: list[Cell], rounds: int = ROUNDS) -> Model:
    """Logistic boosting over counted cells: bits, candidates, those that are true."""
    total, true = sum(n for _, n, _ in cells), sum(y for _, _, y in cells)
    rate = (true + 1) / (total + 2)
    model = Model(math.log(rate / (1 - rate)), [], {})
    width = len(KINDS) + len(FEATURES)
    scores = [model.bias] * len(cells)
    for _ in range(rounds):
        grads, weights = [], []
        for (_, n, y), s in zip(cells, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            grads.append(y - n * p)
            weights.append(n * p * (1 - p))

        def split(rows: list[int]) -> tuple[float, int, tuple[float, float]]:
            best = (-1.0, 0, (0.0, 0.0))
            for bit in range(width):
                sums = [[0.0, 1.0], [0.0, 1.0]]  # gradient, and curvature with a penalty of 1
                for i in rows:
                    side = sums[int(cells[i][0][bit])]
                    side[0] += grads[i]
                    side[1] += weights[i]
                gain = sum(g * g / h for g, h in sums)
                if gain > best[0] + 1e-12:
                    best = (gain, bit, (sums[0][0] / sums[0][1], sums[1][0] / sums[1][1]))
            return best

        everything = list(range(len(cells)))
        options = []
        for root in range(width):
            parts = [[i for i in everything if cells[i][0][root] == bool(s)] for s in (0, 1)]
            if all(parts):
                leaves = [split(p) for p in parts]
                options.append((leaves[0][0] + leaves[1][0], -root, leaves))
        if not options:
            break
        _, root, leaves = max(options)
        limited = tuple(tuple(SHRINK * max(-4.0, min(4.0, v)) for v in leaf[2]) for leaf in leaves)
        tree = Tree(-root, (leaves[0][1], leaves[1][1]), limited)
        model.trees.append(tree)
        scores = [s + tree.score(bits) for s, (bits, _, _) in zip(scores, cells, strict=True)]
    return model


def calibrate(model: Model, cells: list[Cell]) -> Model:
    """Set each kind's threshold: the least score from which on counted candidates are precise enough.

    Candidates of one score stand or fall together. A kind without such a score gets no threshold.
    """
    for k, kind in enumerate(KINDS):
        sums: dict[float, list[int]] = {}
        for bits, n, y in cells:
            if bits[k]:
                own = sums.setdefault(round(model.score(bits), 6), [0, 0])
                own[0] += n
                own[1] += y
        seen = right = 0
        for s, (n, y) in sorted(sums.items(), reverse=True):
            seen, right = seen + n, right + y
            if right >= PRECISION * seen:
                model.thresholds[kind] = s - 1e-6
    return model


def _with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    columns = {"__text": text_or_empty(text_col)}
    found = docs.withColumns(columns)
    generators = {k: v[:2] for k, v in BASE.items()} | {k: v[:2] for k, v in EXTRA.items()}
    return found.withColumns({f"__{kind}": _candidates("__text", kind, *own) for kind, own in generators.items()})


def examples(spark: SparkSession) -> DataFrame:
    """line, nth, kind, personal, start, end, text: ``EACH`` texts of every line of ``EXAMPLES``."""
    rows = [f"named_struct('line', {i}, 'kind', {_quote(k)}, 'personal', {str(p).lower()}, 'left', '{left.replace(chr(39), chr(92) + chr(39))}', 'right', '{right.replace(chr(39), chr(92) + chr(39))}')" for i, (k, p, left, _, right) in enumerate(EXAMPLES)]
    value = "CASE line " + " ".join(f"WHEN {i} THEN {v}" for i, (*_, v, _) in enumerate(EXAMPLES)) + " END"
    made = spark.range(EACH).withColumnRenamed("id", "nth").selectExpr("nth", f"explode(array({', '.join(rows)})) AS r").select("nth", "r.*")
    seed = "xxhash64(line, nth, 7)"
    hashed = made.selectExpr(
        "*",
        f"lower(lpad(hex({seed}), 16, '0')) AS hex",
        f"concat(lpad(pmod(xxhash64(line, nth, 1), 1000000000), 9, '1'), lpad(pmod(xxhash64(line, nth, 2), 1000000000), 9, '2')) AS digits",
        f"element_at(array({', '.join(map(_quote, _WORDS))}), cast(pmod({seed}, {len(_WORDS)}) AS int) + 1) AS word",
    ).withColumn("letters", F.expr("translate(substring(concat(digits, digits), 4, 18), '0123456789', 'KQZJXWVMPT')"))
    valued = hashed.selectExpr("*", f"{value} AS value")
    return valued.selectExpr("line", "nth", "kind", "personal", "length(left) AS start", "length(left) + length(value) AS end", "concat(left, value, right) AS text")


def cells_of(texts: DataFrame) -> list[Cell]:
    """Candidates of texts with a known span (kind, personal, start, end), counted by kind and features.

    Only candidates of that kind that overlap the span count; they are true if it is personal.
    """
    told = [
        f"transform(filter(__{kind}, c -> c.kind = kind AND c.start < end AND start < c.end), c -> named_struct('kind', c.kind, 'bits', array({', '.join(FEATURES.values())})))"
        for kind in EXTRA
    ]
    rows = _with_candidates(texts, "text").selectExpr("personal", f"explode(concat({', '.join(told)})) AS c")
    counts = rows.groupBy("c.kind", *[F.col("c.bits")[i].alias(f"f{i}") for i in range(len(FEATURES))]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("personal").alias("y")
    )
    # bounded: no more cells than examples
    cells = [(tuple(r["kind"] == k for k in KINDS) + tuple(bool(r[f"f{i}"]) for i in range(len(FEATURES))), r["n"], r["y"]) for r in counts.collect()]
    return sorted(cells)


def learn(spark: SparkSession) -> Model:
    """Boost over two thirds of the examples, set the thresholds on the rest."""
    made = examples(spark)
    return calibrate(boost(cells_of(made.where("nth % 3 <> 0"))), cells_of(made.where("nth % 3 = 0")))


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``pii``: an array of kind, start, end by kind and start.

    Positions count code points, the end is exclusive. Base spans all stay, also where kinds overlap.
    A further span stays if it meets its kind's full rule or its score reaches the kind's threshold, if
    it has one, and it overlaps no base span and no further one before it: those that meet their full rule come
    first, then those of higher score; ties go to the one that starts first, then to the kind listed
    first. A null text counts as empty. An input column named ``pii`` is replaced.
    """
    docs = replace_columns(docs, ["pii"])
    span = "named_struct('rank', {rank}, 'kind', c.kind, 'start', c.start, 'end', c.end, 'score', {score})"
    base = [f"transform(filter(__{k}, c -> {RULES[k]}), c -> {span.format(rank=i, score='0D')})" for i, k in enumerate(BASE)]
    extra = []
    for i, k in enumerate(EXTRA, len(BASE)):
        scored = f"transform(__{k}, c -> {span.format(rank=i, score=f'IF({RULES[k]}, {VALID!r}D, 0D) + {model.sql(k)}')})"
        extra.append(f"filter({scored}, c -> c.score >= {model.thresholds.get(k, VALID / 2)!r}D)")
    more = f"concat({', '.join(extra)})"
    order = "(a, b) -> CASE WHEN a.score <> b.score THEN IF(a.score > b.score, -1, 1) WHEN a.start <> b.start THEN a.start - b.start ELSE a.rank - b.rank END"
    found = _with_candidates(docs, text_col).withColumn("__base", F.expr(f"concat({', '.join(base)})"))
    found = found.withColumn("__more", F.expr(f"array_sort({more}, {order})"))
    chosen = "aggregate(__more, __base, (kept, c) -> IF(exists(kept, k -> k.start < c.end AND c.start < k.end), kept, concat(kept, array(c))))"
    by_place = "(a, b) -> CASE WHEN a.rank <> b.rank THEN a.rank - b.rank ELSE a.start - b.start END"
    pii = f"transform(array_sort({chosen}, {by_place}), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))"
    return found.withColumn("pii", F.expr(pii)).select(*docs.columns, "pii")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; null stays null.

    Where spans overlap, the first is named and the rest of the other is covered by it.
    """
    found = annotate(docs, model, text_col).withColumn("__spans", F.expr("array_sort(pii, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.end - a.end END)"))
    pieces = f"""aggregate(__spans, named_struct('at', 0, 'out', ''),
        (a, c) -> IF(c.start < a.at, named_struct('at', greatest(a.at, c.end), 'out', a.out),
            named_struct('at', c.end, 'out', concat(a.out, substring(`{text_col}`, a.at + 1, c.start - a.at), '[', upper(c.kind), ']'))),
        a -> concat(a.out, substring(`{text_col}`, a.at + 1)))"""
    return found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.expr(pieces))).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, learn(spark))
    joined = "array_join(transform({}, c -> concat_ws(':', c.kind, c.start, c.end)), ',')"
    base = "filter(pii, c -> c.kind IN ('email', 'ip', 'card', 'phone'))"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, c -> c.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"),
        F.expr(joined.format("pii")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
