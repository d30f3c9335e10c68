"""Secret scans through a trigram inverted index.

DataFrame functions only. The index maps trigrams, as far as some rule asks for them, to the documents that hold
them, in chunks of documents by hash. Rules are Boolean queries on it: within a chunk, postings are intersected and
united. The candidates are fetched and each is matched by its rules. Rules without a trigram read every text.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import ascii_letters, without
from wattsift.llm.rules import let
from wattsift.llm.trigrams import Query, trigram_query
from wattsift.session import written


@dataclass(frozen=True)
class Rule:
    """Matches of ``regex`` of which group ``group`` (0: the whole) has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1

    @property
    def query(self) -> Query:
        return trigram_query(self.regex)


#: The three kinds of secrets that are asked for, then public formats of keys and tokens.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[^\x20/:@]{1,64}:[^\x20/:@]{1,64}@"),
)

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_letters(False), ascii_letters(True))


def _postings_query(query: Query, post: Column) -> Column:
    """Keys that satisfy the query, from a map of trigram to keys."""
    of = lambda t: F.coalesce(F.get(F.filter(post, lambda p: p["tri"] == t), F.lit(0))["keys"], F.array().cast("array<bigint>"))
    clauses = []
    for alternatives in query:
        met = [reduce(F.array_intersect, [of(t) for t in sorted(a)]) for a in alternatives]
        clauses.append(reduce(F.array_union, met))
    return reduce(F.array_intersect, clauses)


def _text_query(query: Query, low: Column) -> Column:
    """The same query asked of one text."""
    every = lambda tests: reduce(lambda a, b: a & b, tests)
    some = lambda tests: reduce(lambda a, b: a | b, tests)
    return every([some([every([low.contains(t) for t in sorted(a)]) for a in alternatives]) for alternatives in query])


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, leftmost and not overlapping, in code points.

    What lies between the matches comes from splitting at them, so that the lengths add up to positions.
    """
    regex = F.lit(rule.regex)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.regex, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length).alias("length"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length).alias("size"),
    )
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        end = start + p["length"]
        span = F.struct(
            start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("bigint").alias("end")
        )
        grown = F.when(p["size"] >= rule.least, F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct(end.cast("bigint").alias("at"), grown.alias("out"))

    return F.aggregate(F.filter(parts, lambda p: p["length"].isNotNull()), begin, step, lambda a: a["out"])


def _spans_if(test: Column, text: Column, rule: Rule, rank: int) -> Column:
    return F.when(test, spans(text, rule, rank)).otherwise(F.array().cast(f"array<{SPAN}>"))


def build_index(rows: DataFrame, vocabulary: list[str], chunk_rows: int) -> DataFrame:
    """(chunk, tri, keys): the posting lists of (key, text), cut into chunks of about ``chunk_rows`` keys."""
    chunks = rows.count() // chunk_rows + 1
    low = rows.select("key", lowered(F.col("text")).alias("low"))
    tris = F.array(*[F.lit(t) for t in vocabulary])
    held = low.select("key", F.explode(let(F.col("low"), lambda x: F.filter(tris, lambda t: x.contains(t)))).alias("tri"))
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk")
    return held.groupBy(chunk, "tri").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, queries: list[tuple[str, Query]]) -> DataFrame:
    """(key, kinds): the documents that may match, with the rules they may match."""
    post = index.groupBy("chunk").agg(F.collect_list(F.struct("tri", "keys")).alias("post"))
    each = [F.struct(F.lit(kind).alias("kind"), _postings_query(q, F.col("post")).alias("keys")) for kind, q in queries]
    found = post.select(F.explode(F.array(*each)).alias("c")).select("c.kind", F.explode("c.keys").alias("key"))
    return found.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", chunk_rows: int = 4096) -> DataFrame:
    """Add ``secrets``, an array of (start, rank, kind, end) in order of start, rule and end, to every document.

    Positions count code points, ends are exclusive. A rule's matches are leftmost and don't overlap one another. A NULL
    text is empty. Documents are told apart by a 64-bit hash of id and text; repeated rows get the same spans each.
    A column of this name is replaced.
    """
    base = without(docs, "secrets", "secret_key", "secret_found")
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(F.col(id), body)
    rows = docs.select(key.alias("key"), body.alias("text"))
    queries = [(r.kind, r.query) for r in rules if r.query]
    ranked = {r.kind: (rank, r) for rank, r in enumerate(rules)}
    vocabulary = sorted({t for _, q in queries for clause in q for a in clause for t in a})
    out = base.withColumn("secret_key", key)
    scanned = [
        _spans_if(body.rlike(rule.regex), body, rule, rank) for rank, rule in enumerate(rules) if not rule.query
    ] or [F.array().cast(f"array<{SPAN}>")]
    if vocabulary:
        may = written(candidates(build_index(rows, vocabulary, chunk_rows), queries), "candidates")
        low = lowered(F.col("text"))
        asked = let(low, lambda x: reduce(lambda a, b: a | b, [_text_query(q, x) for _, q in queries]))
        fetched = rows.where(asked).join(may, "key")
        each = [
            _spans_if(F.array_contains("kinds", kind), F.col("text"), ranked[kind][1], ranked[kind][0]) for kind, _ in queries
        ]
        found = fetched.select("key", F.concat(*each).alias("secret_found")).where(F.size("secret_found") > 0)
        found = written(found.dropDuplicates(["key"]), "secrets").withColumnRenamed("key", "secret_key")
        own = out.select(*base.columns, "secret_key", F.concat(*scanned).alias("secret_scanned"))
        joined = own.drop(*([text] if text not in base.columns else [])).join(found, "secret_key", "left")
        both = F.concat("secret_scanned", F.coalesce("secret_found", F.array().cast(f"array<{SPAN}>")))
        return joined.select(*base.columns, F.array_sort(both).alias("secrets"))
    return out.select(*base.columns, F.array_sort(F.concat(*scanned)).alias("secrets"))
