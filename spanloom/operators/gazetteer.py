"""Dictionary matching: keys, variants, boundaries, ambiguity, taxa, mapped references.

A gazetteer is a table (id, name) with more columns at will. Two ways to match it: match_tokens joins it with runs of
pieces of text, all in the JVM, any size of dictionary; match_everywhere finds keys at every position with an
Aho-Corasick automaton in Arrow batches. match_variants and match_approximate are token joins too, on names without their
separators; in_scope matches within given spans. Texts that share a doc_id, or have none, are matched each by itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.similarity import column as similarity
from ..functions.text import latin_to_greek
from .segment import tokens, words_laid_out

#: Keys, and characters of keys, of one automaton; a larger dictionary is matched in several passes over the text.
AUTOMATON_KEYS, AUTOMATON_CHARS = 2_000_000, 40_000_000


def key(name: Column, case_sensitive: bool = False) -> Column:
    return name if case_sensitive else F.lower(name)


def with_ids(gazetteer: DataFrame) -> DataFrame:
    """Each id is a name of itself too."""
    return gazetteer.union(gazetteer.withColumn("name", F.col("id").cast("string"))).distinct()


def grouped(gazetteer: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(key, ids, n_ids): the ids of each key, sorted."""
    return gazetteer.where("name is not null").groupBy(key(F.col("name"), case_sensitive).alias("key")).agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("n_ids", F.size("ids"))


def parts(name: str) -> tuple[list[str], list[str]]:
    """(tokens, separators between): cut at spaces and hyphens, between letters and digits, before a capital after a small letter; the last character begins no token."""
    tokens, seps, start = [], [], 0
    i = 1
    while i < len(name) - 1:
        a, b = name[i - 1], name[i]
        if b in " -" and i > start:
            tokens.append(name[start:i])
            seps.append(b)
            start = i + 1
            i += 2
            continue
        if a not in " -" and ((a.isalpha() and b.isdigit()) or (a.isdigit() and b.isalpha()) or (a.islower() and b.isupper())):
            tokens.append(name[start:i])
            seps.append("")
            start = i
        i += 1
    return [*tokens, name[start:]], seps


def variants(name: str) -> Iterator[str]:
    """The name with "-", nothing or a space at each of its gaps; nothing only where there was no space.

    Three to the power of the gaps: match_variants() finds the same in text without listing them.
    """
    tokens, seps = parts(name)
    choices = [["-", " "] if sep == " " else ["-", "", " "] for sep in seps]
    for own in product(*choices):
        yield tokens[0] + "".join(s + t for s, t in zip(own, tokens[1:]))


def with_variants(gazetteer: DataFrame) -> DataFrame:
    """A row more for each variant of a name, all of them; match_variants() does without the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                own = variants(name)
                while some := list(islice(own, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(c.take(pa.array([i] * len(some))) for c in batch.columns[1:])], ["_variant", *rest])

    rest = [c for c in gazetteer.columns if c != "name"]
    own = gazetteer.where("name is not null").select("name", *rest)
    out = own.mapInArrow(run, StructType([StructField("_variant", StringType()), *(own.schema[c] for c in rest)]))
    return out.select(*(F.col("_variant").alias("name") if c == "name" else F.col(c) for c in gazetteer.columns)).distinct()


def _shape(names: pa.Array) -> pa.Array:
    """(bare, gaps, must) of each name: without separators; the places in that where one may be; those where one must be."""
    out = []
    for name in names.to_pylist():
        if name is None:
            out.append(None)
            continue
        tokens, seps = parts(name)
        at = np.cumsum([len(t) for t in tokens])[:-1].tolist()
        out.append({"bare": "".join(tokens), "gaps": at, "must": [i for i, s in zip(at, seps) if s == " "]})
    return pa.array(out, pa.struct([("bare", pa.string()), ("gaps", pa.list_(pa.int32())), ("must", pa.list_(pa.int32()))]))


def with_gaps(gazetteer: DataFrame) -> bool:
    """Whether a name has variants other than itself."""
    return not gazetteer.where("name is not null").select(F.arrow_udf(_shape, "bare string, gaps array<int>, must array<int>")("name").alias("_s")).where(F.size("_s.gaps") > 0).isEmpty()


def with_greek(gazetteer: DataFrame) -> DataFrame:
    """Names with the names of Greek letters are there with the letters as well."""
    return gazetteer.union(gazetteer.withColumn("name", latin_to_greek(F.col("name")))).distinct()


def is_boundary(text: str, at: int) -> bool:
    """Whether character categories change at the place; a capital and small letters after it are one word."""
    if at <= 0 or at >= len(text):
        return True
    last, now = unicodedata.category(text[at - 1]), unicodedata.category(text[at])
    if last == now:
        return False
    if now == "Ll" and last == "Lu":
        return at > 1 and unicodedata.category(text[at - 2]) == "Lu"
    return True


def name_sizes(gazetteer: DataFrame) -> list[int]:
    """The numbers of words that names have, sorted."""
    n = gazetteer.select(F.size(F.regexp_extract_all("name", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("n"))
    return sorted(r.n for r in n.where("n > 0").distinct().collect())


def runs(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, begin, run) for every run of as many words as one of sizes; run is an array of words and of what is between, in turn. All within the row."""
    run = lambda i: F.array_compact(F.array(*(F.get("_a", i + k) for k in range(2 * max(sizes) - 1))))
    own = words_laid_out(docs).select("doc_id", "off", F.posexplode(F.transform("_b", lambda b, i: F.struct(b.alias("begin"), run(i).alias("run")))).alias("pos", "t")).where("(pos + off) % 2 = 0")
    ends = F.filter(F.array(*(F.lit(2 * n - 1) for n in sizes)), lambda n: n <= F.size("t.run"))
    return own.select("doc_id", F.col("t.begin").alias("begin"), F.explode(F.transform(ends, lambda n: F.slice("t.run", F.lit(1), n))).alias("run"))


def match_tokens(docs: DataFrame, gazetteer: DataFrame, case_sensitive: bool = False, most_words: int | None = 1) -> DataFrame:
    """(doc_id, begin, end, match, *gazetteer) wherever a key is a run of 1 to most_words words of the text and what is between.

    Without most_words, runs have the numbers of words that the names have, which are read from the dictionary first.
    The dictionary joins on its key: broadcast by the planner if its statistics say it is small, shuffled otherwise.
    """
    sizes = name_sizes(gazetteer) if most_words is None else list(range(1, most_words + 1))
    if sizes in ([], [1]):
        own = tokens(docs).select("doc_id", "begin", F.col("text").alias("match"))
    else:
        own = runs(docs, sizes).select("doc_id", "begin", F.array_join("run", "").alias("match"))
    keys = gazetteer.where("name is not null").distinct().withColumn("_key", key(F.col("name"), case_sensitive))
    found = own.withColumn("_key", key(F.col("match"), case_sensitive)).join(keys, "_key")
    return found.select("doc_id", "begin", (F.col("begin") + F.length("match")).cast("int").alias("end"), "match", *gazetteer.columns)


def _bare_runs(docs: DataFrame, sizes: list[int], case_sensitive: bool) -> DataFrame:
    """(doc_id, begin, match, _key, _cuts) of runs(): _key without what is between the words, _cuts the places of that in _key."""
    words = F.filter("run", lambda w, i: i % 2 == 0)
    seps = F.filter("run", lambda w, i: i % 2 == 1)
    own = runs(docs, sizes).select("doc_id", "begin", F.array_join("run", "").alias("match"), F.array_join(words, "").alias("_bare"), words.alias("_w"), seps.alias("_seps"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda n: F.aggregate(F.slice("_w", F.lit(1), n), F.lit(0), lambda a, w: a + F.length(w)))
    return own.select("doc_id", "begin", "match", key(F.col("_bare"), case_sensitive).alias("_key"), F.when(F.size("_w") > 1, cuts).otherwise(F.array().cast("array<int>")).alias("_cuts"), "_seps")


def match_variants(docs: DataFrame, gazetteer: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """match_tokens() for all variants() of the names, whatever the number of their gaps: names and runs join without separators, whose places are compared then."""
    shape = F.arrow_udf(_shape, "bare string, gaps array<int>, must array<int>")
    own = gazetteer.where("name is not null").distinct().withColumn("_s", shape("name"))
    most = own.agg(F.max(F.size("_s.gaps"))).first()[0]
    if not most:  # without gaps, a name is its only variant, and its run is one word
        return match_tokens(docs, gazetteer.limit(0) if most is None else gazetteer, case_sensitive)
    text = _bare_runs(docs, list(range(1, most + 2)), case_sensitive).where(F.forall("_seps", lambda s: s.isin("-", " ")))
    found = text.join(own.withColumn("_key", key(F.col("_s.bare"), case_sensitive)), "_key").where((F.size(F.array_except("_cuts", "_s.gaps")) == 0) & (F.size(F.array_except("_s.must", "_cuts")) == 0))
    return found.select("doc_id", "begin", (F.col("begin") + F.length("match")).cast("int").alias("end"), "match", *gazetteer.columns)


def match_approximate(docs: DataFrame, gazetteer: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """match_tokens() whatever is between the words of a name, here and there: both sides join on their letters and digits alone."""
    bare = F.regexp_replace("name", r"[^\p{L}\p{N}]+", "")
    own = gazetteer.where("name is not null").distinct().withColumn("_key", key(bare, case_sensitive)).where("_key <> ''")
    most = own.agg(F.max(F.size(F.regexp_extract_all("name", F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))))).first()[0]
    if most is None:
        return match_tokens(docs, gazetteer.limit(0), case_sensitive)
    found = _bare_runs(docs, list(range(1, most + 1)), case_sensitive).join(own, "_key")
    return found.select("doc_id", "begin", (F.col("begin") + F.length("match")).cast("int").alias("end"), "match", *gazetteer.columns)


def in_scope(docs: DataFrame, scopes: DataFrame, match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What match finds in the text of each of scopes (doc_id, begin, end) by itself, at its place in the document; each once."""
    own = scopes.select("doc_id", "begin", "end").distinct().join(docs.select("doc_id", "text"), "doc_id")
    own = own.select(F.struct("doc_id", F.col("begin").alias("at")).alias("doc_id"), F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("text"))
    found = match(own)
    at = F.col("doc_id.at")
    return found.select(F.col("doc_id.doc_id").alias("doc_id"), *((F.col(c) + at).cast("int").alias(c) if c in ("begin", "end") else F.col(c) for c in found.columns if c != "doc_id")).distinct()


def prefixes(inputs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of inputs (text, ...) with every row of keys (key, ...) whose key their text begins with; the longest last, by "n".

    An equality join on each of the lengths that keys have, instead of a comparison of all pairs. An empty key is in no text.
    """
    sizes = sorted(r.n for r in keys.where("key <> ''").select(F.length("key").alias("n")).distinct().collect())
    at = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("text")) if sizes else F.array().cast("array<int>")
    own = inputs.withColumn("n", F.explode(at)).withColumn("_k", F.substring("text", F.lit(1), F.col("n")))
    return own.join(keys.where("key <> ''"), F.col("_k") == F.col("key")).drop("_k")


_automata: dict[str, object] = {}


def match_everywhere(docs: DataFrame, gazetteer: DataFrame, case_sensitive: bool = False, boundary: bool = False, most_keys: int = AUTOMATON_KEYS, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(doc_id, begin, end, match, ids) of every key at every position, nested and overlapping ones too.

    Lower-casing never changes a length: a character whose small form is longer stays as it is. The dictionary is read
    when this is called and cut into parts of at most about most_keys keys and most_chars characters, each of which is
    broadcast and made an automaton once in a Python worker.
    """
    spark = docs.sparkSession
    keys = grouped(gazetteer, case_sensitive).where("key <> ''")
    many, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    shards = max(1, -(-many // most_keys), -(-size // most_chars))
    keys = keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(shards))).select("key", F.col("ids").cast("array<string>").alias("ids"), "part")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL("begin int, end int, match string, ids array<string>").fields])
    found = None
    for part in range(shards):
        shared = spark.sparkContext.broadcast([(r.key, r.ids) for r in keys.where(F.col("part") == part).select("key", "ids").toLocalIterator()])
        tag = f"{spark.sparkContext.applicationId}:{shared._jbroadcast.id()}"

        def run(batches: Iterator[pa.RecordBatch], shared=shared, tag=tag) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            if tag not in _automata:
                while len(_automata) > 2:
                    _automata.pop(next(iter(_automata)))
                own = ahocorasick.Automaton()
                for k, ids in shared.value:
                    own.add_word(k, (len(k), ids))
                own.make_automaton()
                _automata[tag] = own
            automaton = _automata[tag]
            for batch in batches:
                rows = []
                for row, text in enumerate(batch.column(1).to_pylist() if len(automaton) else []):
                    low = text if case_sensitive or text is None else text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                    for last, (n, ids) in automaton.iter(low or ""):
                        begin, end = last - n + 1, last + 1
                        if not boundary or (is_boundary(text, begin) and is_boundary(text, end)):
                            rows.append((row, begin, end, text[begin:end], ids))
                if rows:
                    d, b, e, m, i = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(m, pa.string()), pa.array(i, pa.list_(pa.string()))], ["doc_id", "begin", "end", "match", "ids"])

        own = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = own if found is None else found.union(own)
    return found


_EXPANSION = re.compile(r"\s?-\s?((?:[A-Za-z]|[α-ωΑ-Ω])?[0-9]*)(?!\w)|/([A-Za-z0-9α-ωΑ-Ω]+)(?!\w)")


def expansion(text: str, begin: int, end: int) -> tuple[str, str, int, int, int] | None:
    """(kind, stem, lo, hi, end) of the further names in "gene 1-4" (n), "gene A-C" (c) or "gene1/2" (=) after the hit text[begin:end].

    The names are the stem with each number, or character of a code, from lo to hi; for "=" the stem itself.
    """
    m = _EXPANSION.match(text, end)
    if not m or not (m[1] or m[2]):
        return None
    hit = text[begin:end]
    if m[2]:
        return ("=", hit[: len(hit) - len(m[2])] + m[2], 0, 0, m.end()) if len(m[2]) < len(hit) else None
    digits = re.search(r"[0-9]+$", hit)
    number = lambda x: int(x) if len(x) < 38 else 10**37
    if digits and m[1].isdigit():
        return "n", hit[: digits.start()], number(digits[0]) + 1, number(m[1]), m.end()
    if len(m[1]) == 1 and m[1].isalpha() and hit and hit[-1].isalpha() and (len(hit) == 1 or not hit[-2].isupper()):
        return "c", hit[:-1], ord(hit[-1]) + 1, ord(m[1]), m.end()
    return None


def _expand(texts: pa.Array, hits: pa.Array) -> pa.Array:
    """The lists after the hits (begin, end) of each text."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("stem", pa.string()), ("lo", pa.decimal128(38)), ("hi", pa.decimal128(38))]))
    out = []
    for text, own in zip(texts.to_pylist(), hits.to_pylist()):
        rows = []
        for h in (own or ()) if text is not None else ():
            if x := expansion(text, h["begin"], h["hit"]):
                rows.append({"begin": h["begin"], "end": x[4], "kind": x[0], "stem": x[1], "lo": Decimal(x[2]), "hi": Decimal(x[3])})
        out.append(rows)
    return pa.array(out, kind)


def match_expansions(docs: DataFrame, mentions: DataFrame, gazetteer: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, begin, end, match, id): names that a list after a mention stands for.

    A list isn't written out, however long: its stem joins with those of the dictionary's names, and the number or
    letter at their end must be in its range.
    """
    make = F.arrow_udf(_expand, "array<struct<begin: int, end: int, kind: string, stem: string, lo: decimal(38,0), hi: decimal(38,0)>>")
    per = mentions.groupBy("doc_id").agg(F.collect_set(F.struct("begin", F.col("end").alias("hit"))).alias("_hits"))
    own = docs.select("doc_id", "text").join(per, "doc_id").withColumn("_x", make("text", "_hits"))
    own = own.select("doc_id", F.explode(F.transform("_x", lambda x: F.struct(x.alias("x"), F.substring("text", x["begin"] + 1, x["end"] - x["begin"]).alias("match")))).alias("y")).select("doc_id", "y.x.*", "y.match")
    own = own.withColumn("_stem", key(F.col("stem"), case_sensitive)).drop("stem")
    name = key(F.col("name"), case_sensitive)
    digits = F.regexp_extract(name, r"^(?s:.*?)(0|[1-9][0-9]{0,36})$", 1)
    entry = lambda kind, stem, at: F.struct(F.lit(kind).alias("kind"), stem.alias("_stem"), at.try_cast("decimal(38,0)").alias("at"))
    whole = entry("=", name, F.lit(0))
    numbered = F.when(digits != "", entry("n", F.substring(name, F.lit(1), F.length(name) - F.length(digits)), digits))
    lettered = entry("c", F.substring(name, F.lit(1), F.length(name) - 1), F.ascii(F.substring(name, -1, 1)))
    keys = gazetteer.where("name <> ''").select("id", F.explode(F.array_compact(F.array(whole, numbered, lettered))).alias("k")).select("id", "k.*").distinct()
    if not case_sensitive:  # a range of capitals is one of small letters
        low = lambda c: F.when((F.col("kind") == "c") & (F.col(c).between(65, 90) | F.col(c).between(0x391, 0x3A9)), F.col(c) + 32).otherwise(F.col(c)).cast("decimal(38,0)")
        own = own.withColumns({"lo": low("lo"), "hi": low("hi")})
    return own.join(keys, ["kind", "_stem"]).where("at between lo and hi").select("doc_id", "begin", "end", "match", "id").distinct()


def listed(mentions: DataFrame, allowed: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Mentions whose text is in the first column of allowed, if given, and not in that of blocked."""
    if allowed is not None:
        mentions = mentions.join(allowed.toDF("_m"), F.col("match") == F.col("_m"), "left_semi")
    if blocked is not None:
        mentions = mentions.join(blocked.toDF("_m"), F.col("match") == F.col("_m"), "left_anti")
    return mentions


def best_names(mentions: DataFrame, gazetteer: DataFrame, measure: str = "case_similarity", least: float = 0.0) -> DataFrame:
    """Adds name and confidence: the id's name most like the match, the first of equals; those below least go."""
    names = gazetteer.select(F.col("id").alias("_id"), F.col("name").alias("_name")).distinct()
    pairs = mentions.select("match", "id").distinct().join(names, F.col("id") == F.col("_id")).withColumn("_sim", similarity(measure)("match", "_name"))
    best = pairs.groupBy("match", "id").agg(F.min_by("_name", F.struct(-F.col("_sim"), F.col("_name"))).alias("name"), F.max("_sim").alias("confidence"))
    return mentions.drop("name").join(best, ["match", "id"]).where(F.col("confidence") >= least)


def in_taxa(mentions: DataFrame, taxa: DataFrame) -> DataFrame:
    """Mentions of a taxon that the document has; a document without taxa keeps all. taxa: (doc_id, taxon)."""
    t = taxa.select(F.col("doc_id").alias("_d"), F.col("taxon").alias("_t")).distinct()
    per = t.groupBy("_d").agg(F.collect_set("_t").alias("_all"))
    return mentions.join(per, mentions.doc_id == F.col("_d"), "left").where(F.col("_all").isNull() | F.array_contains("_all", F.col("taxon"))).drop("_d", "_all")


def remapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The column by mapping (key, value); what isn't there stays."""
    m = mapping.toDF("_k", "_v")
    return df.join(m, F.col(column) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def with_reference(mentions: DataFrame, references: DataFrame) -> DataFrame:
    """Adds to properties the reference (namespace, accession) of the id, none if none. Of several, tables having no order, the greatest, where a file would have the last."""
    r = references.groupBy(F.col("id").alias("_id")).agg(F.max(F.struct(F.col("namespace").alias("name"), F.col("accession").alias("value"))).alias("_ref"))
    out = mentions.join(r, F.col("id") == F.col("_id"), "left")
    return out.withColumn("properties", F.when(F.col("_ref").isNull(), F.col("properties")).otherwise(F.array_append("properties", F.col("_ref")))).drop("_id", "_ref")
