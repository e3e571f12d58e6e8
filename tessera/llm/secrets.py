"""Operator 3: secret scans with patterns and character Markov models, in SQL functions only.

Three fixed patterns give the base spans. The method adds spans: base matches are blanked,
kind by kind, and in what is left every run of at least ``MIN_RUN`` characters of the
alphabet of keys is scored. Its characters may follow one another as in random strings or as
in ordinary identifiers; both are first-order Markov models with add-one smoothing, fitted on
labelled samples, and the score of a stretch is the sum of log-likelihood ratios of its pairs
of characters, held as whole thousandths so that any engine adds them up alike. Of each run
the stretch of ``MIN_RUN`` characters or more with the highest score counts, so a key is found
behind a path or a long name too.

Positions are code points. They come from cutting the text at the pattern and adding up the
lengths of pieces and matches, all inside the scan; no row leaves its partition. Work grows
with the length of a text and, for n matches, with n: they are added up ``CHUNK`` at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole_text

# The base patterns, and the least lengths of what they match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
#: A stretch is reported from this score on: odds of e^12 for random, in thousandths.
LEAST_SCORE = 12_000
#: Matches of a text that are added up at a time.
CHUNK = 256
#: Random strings and identifiers that the models are fitted on.
SAMPLES = 6_000

# Ordinary words that identifiers and prose are made of.
WORDS = """
account action active address amount answer article author available balance batch before between binary block branch
buffer build button cache cancel catalog change channel character check client cluster code collection column command
company complete config connection consumer container content context control convert counter country create current
customer data database date default delete deliver description detail develop device directory display document driver
element enable encode engine entity error event example exception execute export factory feature field file filter
find folder format forward function general generate government group handler header history image implementation
important import include index information initial input instance integer interface internal item journal kernel
language layout length level library listener local location manager memory message method model module monitor
über haben werden gesellschaft verantwortung geschwindigkeit entwicklung zusammenarbeit wissenschaft möglichkeit
développement gouvernement entreprise toujours maintenant quelque chose notamment environnement connaissance
desarrollo gobierno conocimiento responsabilidad universidad información siguiente trabajo comunidad administración
""".split()


def _digits(*parts) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest(), "big")


def random_strings(n: int = SAMPLES) -> list[str]:
    """Strings drawn evenly over the alphabets that keys are written in, by hashing."""
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62])
    out = []
    for i in range(n):
        letters = alphabets[i % len(alphabets)]
        pool, size = _digits("random", i) * (1 << 256) + _digits("more", i), 20 + i % 25
        chars = []
        for _ in range(size):
            pool, k = divmod(pool, len(letters))
            chars.append(letters[k])
        out.append("".join(chars))
    return out


def ordinary_identifiers(n: int = SAMPLES) -> list[str]:
    """Words joined as programs, paths, prose and file names join them; some end in a date or a number."""
    plain = ["".join(c for c in w if c in ALPHABET) for w in WORDS]
    out = []
    for i in range(n):
        pool = _digits("identifier", i)
        words = []
        for _ in range(3 + i % 3):
            pool, k = divmod(pool, len(plain))
            words.append(plain[k])
        style = i % 8
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = "".join(w.capitalize() for w in words)
        elif style == 2:
            text = "-".join(words)
        elif style == 3:
            text = "/".join(words)
        elif style == 4:
            text = "_".join(words).upper()
        elif style == 5:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 6:
            text = "".join(words)
        else:
            text = "-".join(words[:2]) + f"-{2000 + pool % 30}-{1 + pool % 12:02d}-{1 + pool % 28:02d}"
        out.append(text)
    return out


def fit_ratios(random: list[str], ordinary: list[str]) -> list[int]:
    """Log-likelihood ratio of each pair of characters, in thousandths, row by row of the alphabet."""

    def model(samples):
        pairs = Counter(a + b for s in samples for a, b in zip(s, s[1:], strict=False))
        first = Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
        return {a + b: math.log((pairs[a + b] + 1) / (first[a] + len(ALPHABET))) for a in ALPHABET for b in ALPHABET}

    p, q = model(random), model(ordinary)
    return [round(1000 * (p[a + b] - q[a + b])) for a in ALPHABET for b in ALPHABET]


def markov_ratios() -> list[int]:
    return fit_ratios(random_strings(), ordinary_identifiers())


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and stands once in the plan, also where Spark moves a filter below."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap, each with the piece of text before it."""

    def pairs(t):
        pieces, matches = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        paired = _let(matches, lambda ms: F.zip_with(F.slice(pieces, F.lit(1), F.size(ms)), ms, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))))
        return F.when(t.rlike(pattern), paired).otherwise(_no_pairs())

    return _let(text, pairs)


def _no_pairs() -> Column:
    return F.array().cast("array<struct<piece:string,match:string>>")


def _width(pair: Column) -> Column:
    return F.length(pair["piece"]) + F.length(pair["match"])


def _spans(cut: str, rank: int, keep=None) -> Column:
    """(start, rank, end, match) of the matches in a column made by ``_cut``, as far as ``keep`` holds for them.

    An array that grows by one is copied each time, so it is a chunk's array that grows, from the chunk's own start.
    """
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,match:string>>")

    def step(state, pair):
        start, end = state["at"] + F.length(pair["piece"]), state["at"] + _width(pair)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(span)).alias("done"))

    def of_chunks(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + _width(x)))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        placed = F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, at: F.struct(c.alias("pairs"), at.alias("at")))
        return F.flatten(F.transform(placed, lambda c: F.aggregate(c["pairs"], F.struct(c["at"].alias("at"), empty.alias("done")), step, lambda s: s["done"])))

    def of_pairs(pairs):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(pairs) > 0, _let(chunks, of_chunks)).otherwise(empty)

    found = _let(F.col(cut), of_pairs)
    return found if keep is None else F.filter(found, keep)


def _blanked(text: str, cut: str, keep=None) -> Column:
    """The text with as many spaces in place of each match of its cut, as far as ``keep`` holds for it."""
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    filled = lambda x: blank(x["match"]) if keep is None else F.when(keep(x), blank(x["match"])).otherwise(x["match"])

    def fill(t, pairs):
        done = F.array_join(F.transform(pairs, lambda x: F.concat(x["piece"], filled(x))), "")
        rest = F.aggregate(pairs, F.lit(1), lambda s, x: s + _width(x))
        return F.when(F.size(pairs) > 0, F.concat(done, F.substring(t, rest, F.length(t)))).otherwise(t)

    return _let(F.col(text), lambda t: _let(F.col(cut), lambda pairs: fill(t, pairs)))


def _stretch(match: Column, ratios: list[int]) -> Column:
    """(score, first, last) of the best stretch of MIN_RUN or more characters: its score, its first pair and its last.

    Of equal scores the one that ends first, then the one that starts first.
    """
    least = MIN_RUN - 1
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    codes = F.transform(F.split(match, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair_of = lambda a, b: F.element_at(table, a * len(ALPHABET) + b + 1)
    steps_of = lambda cs: F.zip_with(F.slice(cs, F.lit(1), F.size(cs) - 1), F.slice(cs, F.lit(2), F.size(cs) - 1), pair_of)
    none = -(2**30)
    zero = F.struct(*[F.lit(v).alias(c) for c, v in (("i", 0), ("near", 0), ("run", none), ("from", 0), ("score", none), ("first", 0), ("last", 0))])

    def walk(s, x):
        i, near = s["i"] + 1, s["near"] + x["step"] - x["late"]
        longer = s["run"] + x["step"]
        extends = (longer >= near) & (s["run"] > none)
        run = F.when(i < least, F.lit(none)).when(extends, longer).otherwise(near)
        start = F.when(extends, s["from"]).otherwise(i - least)
        better = run > s["score"]
        pick = lambda new, old: F.when(better, new).otherwise(s[old]).alias(old)
        return F.struct(i.alias("i"), near.alias("near"), run.alias("run"), start.alias("from"), pick(run, "score"), pick(start, "first"), pick(i, "last"))

    def best(steps):
        late = F.slice(F.concat(F.array_repeat(F.lit(0), least), steps), F.lit(1), F.size(steps))
        pairs = F.zip_with(steps, late, lambda a, b: F.struct(a.alias("step"), b.alias("late")))
        return F.aggregate(pairs, zero, walk, lambda s: F.struct(*[s[c].alias(c) for c in ("score", "first", "last")]))

    return _let(codes, lambda cs: _let(steps_of(cs), best))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, ratios: list[int] | None = None, least_score: int = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, base (spans of the three patterns) and markov (added spans).

    A span is (start, rank of its kind, end, match), in code points, end exclusive. Null
    and empty texts have no spans; repeated rows are scanned each; an empty table gives no
    rows. Other columns are ignored.
    """
    ratios = markov_ratios() if ratios is None else ratios
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST
    found = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    found = found.select("*", *[_cut(F.col("_text"), p).alias(f"_cut{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX))])
    found = found.withColumn("base", F.concat(_spans("_cut0", 0, long_enough), _spans("_cut1", 1), _spans("_cut2", 2)))
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        again = F.when(F.size("base") > 0, _cut(F.col("_text"), pattern)).otherwise(_no_pairs())
        found = found.withColumn("_cut", F.col("_cut0") if k == 0 else again)
        found = found.withColumn("_text", _blanked("_text", "_cut", None if k else long_enough))
    found = found.select("_id", "base", _cut(F.col("_text"), RUN).alias("_cut")).select("_id", "base", _spans("_cut", 3).alias("runs"))
    scored = F.transform("runs", lambda r: F.struct(r.alias("run"), _stretch(r["match"], ratios).alias("best")))
    random = F.transform(
        F.filter(scored, lambda x: x["best"]["score"] >= least_score),
        lambda x: F.struct(
            (x["run"]["start"] + x["best"]["first"]).alias("start"), x["run"]["rank"].alias("rank"), (x["run"]["start"] + x["best"]["last"] + 1).alias("end"),
            F.substring(x["run"]["match"], x["best"]["first"] + 1, x["best"]["last"] + 1 - x["best"]["first"]).alias("match"),
        ),
    )
    return found.select(F.col("_id").alias(id_col), "base", F.when(F.size("runs") > 0, random).otherwise(F.col("runs")).alias("markov"))


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, the digest of the base spans, and all spans as one string."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    bare = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    spans = found.select(id_col, "base", bare("base").alias("_base"), bare("markov").alias("_markov"))
    return spans.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("_base", "_markov")).alias("spans"),
    )


def scan_sql(docs: str = "documents") -> str:
    """The digests as DuckDB SQL, with the fitted ratios as a list; best stretches by running minima of prefix sums."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spans(rank: int, pattern: str, source: str) -> str:
        value = f"regexp_extract(m, {quote(ASSIGN)}, 2)" if rank == 0 else "NULL"
        return f"""
  SELECT doc_id, {rank} AS rank, m, {value} AS value,
         sum(length(piece) + length(m)) OVER (PARTITION BY row ORDER BY i) AS stop, row
  FROM (SELECT doc_id, row, unnest(regexp_extract_all(text, {quote(pattern)})) AS m,
               unnest(string_split_regex(text, {quote(pattern)})[:-2]) AS piece,
               unnest(range(len(regexp_extract_all(text, {quote(pattern)})))) AS i
        FROM {source} WHERE regexp_matches(text, {quote(pattern)}))"""

    def blanked(pattern: str, source: str, test: str = "TRUE") -> str:
        cut = f"string_split_regex(text, {quote(pattern)})"
        filled = f"list_transform(list_zip({cut}[:-2], regexp_extract_all(text, {quote(pattern)})), lambda x: x[1] || CASE WHEN {test} THEN repeat(' ', length(x[2])) ELSE x[2] END)"
        return f"SELECT doc_id, row, CASE WHEN regexp_matches(text, {quote(pattern)}) THEN array_to_string({filled}, '') || {cut}[-1] ELSE text END AS text FROM {source}"

    place = lambda i: f"instr('{ALPHABET}', substr(m, {i}, 1))"
    least = MIN_RUN - 1
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM {docs}),
ratios AS (SELECT {markov_ratios()} AS r),
blank1 AS MATERIALIZED ({blanked(ASSIGN, "texts", f"length(regexp_extract(x[2], {quote(ASSIGN)}, 2)) >= {ASSIGN_LEAST}")}),
blank2 AS MATERIALIZED ({blanked(ACCESS, "blank1")}),
blank3 AS MATERIALIZED ({blanked(HEX, "blank2")}),
spans AS ({" UNION ALL ".join([spans(0, ASSIGN, "texts"), spans(1, ACCESS, "texts"), spans(2, HEX, "texts"), spans(3, RUN, "blank3")])}),
placed AS (SELECT doc_id, row, rank, m, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM spans
           WHERE rank <> 0 OR length(value) >= {ASSIGN_LEAST}),
steps AS (
  SELECT doc_id, row, rank, start, unnest(range(0, length(m))) AS k, unnest(list_prepend(0, list_transform(range(1, length(m)), lambda i: r[({place("i")} - 1) * {len(ALPHABET)} + {place("i + 1")}]))) AS step
  FROM placed, ratios WHERE rank = 3),
sums AS (SELECT *, sum(step) OVER (PARTITION BY row, start ORDER BY k) AS total FROM steps),
lows AS (SELECT *, min(total) OVER (PARTITION BY row, start ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND {least} PRECEDING) AS low FROM sums),
best AS (SELECT *, row_number() OVER (PARTITION BY row, start ORDER BY total - low DESC, k) AS place FROM lows WHERE low IS NOT NULL),
added AS (
  SELECT b.doc_id, b.row, b.rank, '' AS m, b.start + min(s.k) AS start, b.start + b.k + 1 AS stop
  FROM best b JOIN sums s ON b.row = s.row AND b.start = s.start AND s.k <= b.k - {least} AND s.total = b.low
  WHERE b.place = 1 AND b.total - b.low >= {LEAST_SCORE} GROUP BY b.doc_id, b.row, b.rank, b.start, b.k),
named AS (
  SELECT *, {list(KINDS)}[rank + 1] || ':' || start || ':' || stop AS name FROM (SELECT * FROM placed WHERE rank < 3 UNION ALL SELECT * FROM added))
SELECT t.doc_id,
       count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY start, rank), '') AS spans
FROM texts t LEFT JOIN named n ON t.row = n.row
GROUP BY t.row, t.doc_id
"""
