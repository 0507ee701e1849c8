"""The ready-made pipelines. Each takes documents (doc_id, text) or raw ones and returns a DataFrame; nothing runs before it is written.

Sentence filters come before taggers, so that Python sees fewer sentences. Stages that aren't configured are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import entities, extract, filters, gazetteer, joins, patterns, rank, relations, segment, tagging
from ..sinks import lines
from ..sources import files


@dataclass
class Options:
    newlines: str = "successive"
    greek_to_latin: bool = False
    tagger: tagging.Tagger = tagging.rule_tagger
    sentence_patterns: list[str] = field(default_factory=list)
    remove_sentences: bool = False
    pos_tags: list[str] | None = None
    context: dict[str, list[str]] | None = None
    context_whitelist: bool = False
    minimum_similarity: float = 0.0
    weights: dict[str, float] | None = None
    variants: bool = True  #: names match with "-", a space or nothing at their gaps


def text_of(raw: DataFrame, o: Options = Options(), kind: Column | None = None) -> DataFrame:
    """extract: (doc_id, text, structure) of raw files (doc_id, uri, mime, raw)."""
    kind = extract.kind_of(F.col("uri"), F.col("raw"), F.col("mime")) if kind is None else kind
    return extract.extract(raw, kind=kind, greek_to_latin=o.greek_to_latin)


def split(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """split: sentences, those of the patterns if there are any."""
    own = segment.sentences(docs, o.newlines)
    return filters.sentences_matching(own, o.sentence_patterns, o.remove_sentences) if o.sentence_patterns else own


def preprocess(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """pre: tagged sentences (doc_id, sent_no, begin, end, tokens)."""
    return tagging.tag_sentences(split(docs, o), o.tagger)


def tag(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """tag: (doc_id, line_no, line) of tagged sentences."""
    return lines.lines_of_tagged(preprocess(docs, o))


def grep(docs: DataFrame, resource: list[tuple[str, list[tuple[str, str]]]], o: Options = Options()) -> DataFrame:
    """grep: annotations of syntax patterns."""
    own = patterns.annotate(split(docs, o), resource, o.tagger)
    return own.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").withColumn("match", F.substring("_t", F.col("begin") + 1, F.col("end") - F.col("begin"))).drop("_t")


def grep_sentences(docs: DataFrame, resource: list[tuple[str, list[tuple[str, str]]]], o: Options = Options()) -> DataFrame:
    """grep -c: the sentences with a match."""
    hit = patterns.annotate(split(docs, o), resource, o.tagger).select("doc_id", "sent_no").distinct()
    return split(docs, o).join(hit, ["doc_id", "sent_no"], "left_semi")


def match_taxa(docs: DataFrame, species: DataFrame, stop: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """match: species mentions (doc_id, begin, end, match, taxon, confidence); species: (id, name, prob), stop: (id, name) not to be taken."""
    own = gazetteer.match_tokens(docs, species, most_words=None)
    if stop is not None:
        s = stop.select(F.col("id").alias("_i"), F.lower("name").alias("_n"))
        own = own.join(s, (F.col("id") == F.col("_i")) & (F.lower("match") == F.col("_n")), "left_anti")
    own = own.withColumnRenamed("id", "taxon")
    if mapping is not None:
        own = gazetteer.remapped(own, "taxon", mapping)
    n = rank.counts(own.withColumn("id", F.col("taxon"))).withColumn("confidence", F.coalesce("prob", 1.0 / F.col("ambiguity")))
    return n.select("doc_id", "begin", "end", "match", "taxon", "confidence")


def entity_spans(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """bioner: (doc_id, begin, end, label, match) by the entity tags of the tagger."""
    own = preprocess(docs, o)
    out = lambda t: F.coalesce(t["ner"], F.lit("O")) == "O"
    kept = F.filter("tokens", lambda t, i: ~out(t) | (i == 0) | ~out(F.get("tokens", i - 1)))  # of tokens without a tag in a row, the first alone ends a span
    tok = tagging.token_rows(own.withColumn("tokens", kept)).withColumn("key", F.struct("sent_no", "tok_no"))
    own = segment.bio_spans(tok.drop("tok_no").withColumnRenamed("key", "tok_no"), F.coalesce("ner", F.lit("O")))
    return own.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").withColumn("match", F.substring("_t", F.col("begin") + 1, F.col("end") - F.col("begin"))).drop("_t")


def normalize(docs: DataFrame, genes: DataFrame, o: Options = Options(), taxa: DataFrame | None = None, references: DataFrame | None = None, counts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """norm: mentions of genes (id, taxon, name) with name, confidence, properties and, with weights, a rank score.

    taxa restricts documents to the taxa they mention; references map ids; counts are (links, symbols, references) of the
    features.
    """
    names = gazetteer.with_greek(genes)
    own = gazetteer.match_tokens(docs, names, most_words=None)
    if o.variants and gazetteer.with_gaps(names):
        own = gazetteer.match_variants(docs, names).unionByName(own)
    own = files.kept(own.dropDuplicates(["doc_id", "begin", "end", "id"]))  # read twice, for names and for mentions
    own = gazetteer.best_names(own, genes, least=o.minimum_similarity)
    if taxa is not None:
        own = gazetteer.in_taxa(own, taxa)
    if o.pos_tags or o.context:
        around = joins.surroundings(own, tagging.token_rows(preprocess(docs, o)))
        own = filters.by_context(own, around, o.pos_tags, o.context, o.context_whitelist)
    p = lambda n: F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
    own = own.withColumn("properties", F.array(p("name"), p("taxon")))
    if references is not None:
        own = gazetteer.with_reference(own, references)
    if o.weights:
        ner = entity_spans(docs, o).select("doc_id", "begin", "end", "label")
        spans = taxa.select("doc_id", "taxon", "begin", "end") if taxa is not None and "begin" in taxa.columns else own.limit(0).select("doc_id", "taxon", "begin", "end")
        none = own.select(F.col("id"), F.lit(0).alias("n")).limit(0)
        links, symbols, refs = counts or (none, none, own.select("id", F.col("match").alias("name"), F.lit(0).alias("n")).limit(0))
        own = rank.features(own, spans, ner, links, symbols, refs).withColumn("score", rank.linear_score(o.weights))
    return own


def interactions(docs: DataFrame, sources: DataFrame, targets: DataFrame, o: Options = Options(), **more) -> DataFrame:
    """ginx: co-occurrences of two dictionaries (id, taxon, name) in a sentence."""
    kinds = []
    for kind, genes in (("source", sources), ("target", targets)):
        kinds.append(normalize(docs, genes, o, **more).select("doc_id", "begin", "end", F.lit(kind).alias("namespace"), F.col("id").alias("identifier")))
    return relations.cooccurrence(split(docs, o), *kinds)


def regulations(docs: DataFrame, resource: list[tuple[str, list[tuple[str, str]]]], genes: dict[str, DataFrame], o: Options = Options()) -> DataFrame:
    """grex: pattern relations each of whose parts named in genes contains a mention of that dictionary."""
    own = patterns.annotate(split(docs, o), resource, o.tagger).where("part >= 0 and doc_id is not null")
    rel = own.select("doc_id", F.concat_ws(":", "sent_no", "pattern", "match_no").alias("rel_id"), "part", "begin", "end", "namespace", "identifier")
    good = F.lit(True)
    for k, (name, dictionary) in enumerate(genes.items()):
        rel = filters.holding(rel, normalize(docs, dictionary, o), f"_hit{k}")
        mine = F.col("identifier") == name
        good &= (F.count_if(mine) > 0) & F.every(F.when(mine, F.col(f"_hit{k}")).otherwise(True))
    targets = F.array_sort(F.collect_list(F.struct("begin", "end", "namespace", "identifier")))
    return rel.groupBy("doc_id", "rel_id").agg(targets.alias("targets"), good.alias("_good")).where("_good").drop("_good")


def known(docs: DataFrame, wanted: DataFrame, names: DataFrame) -> DataFrame:
    """entities: mentions of the recorded entities of each document."""
    return entities.known_entities(docs, wanted, names)


def relation_texts(docs: DataFrame, wanted: DataFrame, names: DataFrame, known_relations: DataFrame, o: Options = Options(), most: int = 0) -> DataFrame:
    """patterns: (doc_id, sent_no, pattern) of the sentences with all entities of a known relation (doc_id, rel)."""
    found = known(docs, wanted, names)
    own = found.select("doc_id", "begin", "end", "namespace", F.col("id").alias("identifier"))
    sent = split(docs, o)
    rel = relations.known(sent, own, known_relations)
    pairs = joins.within(own, sent.select("doc_id", "sent_no", "begin", "end", "text"), "s_").join(rel.select("doc_id", F.col("sent_no").alias("s_sent_no"), "rel"), ["doc_id", "s_sent_no"]).where(F.array_contains("rel", F.col("identifier")))
    per = pairs.groupBy("doc_id", F.col("s_sent_no").alias("sent_no"), "s_begin", "s_text", "rel").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "identifier"))).alias("e"))

    def texts(begin: int, text: str, e: list) -> list[str]:
        try:
            chunks = o.tagger(text)
        except (ValueError, OSError):
            chunks = []
        spans, start = [], 0
        for c in chunks:
            start = c["begin"] if c["chunk_begin"] else start
            if c["chunk_end"]:
                spans.append((start, c["end"], c["chunk"]))
        return tagging.relation_patterns(text, [(x["begin"] - begin, x["end"] - begin, x["identifier"]) for x in e], spans, most)

    return per.select("doc_id", "sent_no", F.explode(F.udf(texts, "array<string>", useArrow=True)("s_begin", "s_text", "e")).alias("pattern")).distinct()
