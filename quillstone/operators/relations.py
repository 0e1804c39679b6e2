"""Links between documents, duplicates, and the concept graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body_hash, link_keys, normal_title, segments, wikilinks
from ..session import kept


def extract_links(docs: DataFrame) -> DataFrame:
    """(src_document, dst_target, rel) from documents (id, body)."""
    return docs.select(F.col("id").alias("src_document"), F.explode(wikilinks(F.col("body"))).alias("dst_target"), F.lit("mentions").alias("rel"))


def resolve_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds dst_document: the document that a target's name or its slug means; of several the first by path, null if none."""
    keys = docs.select("id", "path", F.explode(link_keys(F.col("path"), F.col("title"))).alias("dst_target"))
    first = keys.groupBy("dst_target").agg(F.min_by("id", F.struct("path", "id")).alias("dst_document"))
    return links.drop("dst_document").join(first, "dst_target", "left").select("src_document", "dst_target", "dst_document", "rel")


def outgoing(links: DataFrame, docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("id").alias("dst_document"), F.col("title").alias("dst_title"))
    return links.join(named, "dst_document", "left").withColumn("resolved", F.col("dst_document").isNotNull())


def backlinks(links: DataFrame, docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("id").alias("src_document"), F.col("title").alias("src_title"))
    return links.where("dst_document IS NOT NULL").join(named, "src_document", "left")


def related(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document what it links to and what links to it."""
    out = outgoing(links, docs).groupBy(F.col("src_document").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst_target", "dst_document", "resolved"))).alias("outgoing"))
    back = backlinks(links, docs).groupBy(F.col("dst_document").alias("id")).agg(F.sort_array(F.collect_list(F.struct("src_document", "src_title"))).alias("backlinks"))
    return out.join(back, "id", "full")


def incoming_counts(links: DataFrame) -> DataFrame:
    return links.where("dst_document IS NOT NULL").groupBy("dst_document").agg(F.count("*").alias("incoming"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(path, canonical_id, body_hash) for documents whose stripped body an earlier path has."""
    rows = docs.select("id", "path", body_hash(F.col("body")).alias("body_hash"))
    first = rows.groupBy("body_hash").agg(F.min_by("id", F.struct("path", "id")).alias("canonical_id"))
    return rows.join(first, "body_hash").where("id <> canonical_id").select("path", "canonical_id", "body_hash")


def named_duplicates(duplicates: DataFrame, docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("id").alias("canonical_id"), F.col("path").alias("canonical_path"))
    return duplicates.join(named, "canonical_id", "left")


def possible_duplicates(titles: DataFrame) -> DataFrame:
    """Groups of rows (name, title) whose title, without all but letters and digits, is the same and six or longer."""
    key = normal_title(F.col("title"))
    groups = titles.withColumn("key", key).where(F.length("key") >= 6).groupBy("key")
    return groups.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), "; ").alias("names")).where("n > 1")


def graph_nodes(chunks: DataFrame) -> DataFrame:
    """Concepts, one for each prefix of a heading path, and chunks.  A path that several sources share is one concept."""
    parts = segments(F.col("heading_path"))
    prefixes = chunks.select("chunk_id", "source", F.posexplode(parts).alias("pos", "title"), parts.alias("parts"))
    concept = prefixes.select(F.array_join(F.slice("parts", F.lit(1), F.col("pos") + 1), " > ").alias("id"), "title", "source", "chunk_id")
    concepts = concept.groupBy("id").agg(F.min("title").alias("title"), F.min_by("source", "chunk_id").alias("source"))
    concepts = concepts.select("id", F.lit("concept").alias("kind"), "title", "source", F.lit(None).cast("string").alias("heading_path"))
    return concepts.unionByName(chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), F.lit(None).cast("string").alias("title"), "source", "heading_path"))


def graph_contains(chunks: DataFrame) -> DataFrame:
    """(src, dst, kind) from each concept to the concepts and chunks right below it."""
    parts = segments(F.col("heading_path"))
    step = chunks.select("chunk_id", F.posexplode(parts).alias("pos", "_"), parts.alias("parts"))
    here = F.array_join(F.slice("parts", F.lit(1), F.col("pos") + 1), " > ")
    below = F.when(F.col("pos") + 1 == F.size("parts"), F.col("chunk_id")).otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("pos") + 2), " > "))
    return step.select(here.alias("src"), below.alias("dst"), F.lit("contains").alias("kind")).distinct()


#: Words of a title that texts are looked through for; longer titles are then matched in full.
GRAM = 3
#: First words of titles that are named in the scan of the texts, and titles and concepts that are sent to it.
NAMED, SENT = 2_000, 20_000


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def _quoted(title: Column) -> Column:
    """The pattern of a title as whole words."""
    return F.concat(F.lit(r"(?U)\b"), F.regexp_replace(title, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b"))


def _mentioned(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(chunk_id, title) where a text holds a title of ``titles`` (title, lower-cased) as whole words, but not under it.

    A text that holds a title holds its first word.  Few titles go to the texts, which are looked through for their first words where they
    are read; only texts that hold one meet the titles, and nothing but hits is shuffled.  Of many titles the first ``GRAM`` words
    stand in a text that holds it, so hashes of the runs of so many words meet hashes of titles in an equi-join; texts are
    then joined to the hits of titles that are more than one word, and matched in full.
    """
    own = F.transform(segments(F.col("heading_path")), F.lower)
    one = F.col("title").rlike(r"^(?U)\w+$")
    named = kept(titles.withColumn("w", _words(F.col("title"))).where(F.size("w") > 0), "titles")
    first = [r.first for r in named.select(F.col("w")[0].alias("first")).distinct().limit(NAMED + 1).collect()]
    if len(first) <= NAMED and named.count() <= SENT:
        rows = chunks.select("chunk_id", F.lower("text").alias("text"), own.alias("own"))
        held = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), lambda w: w.isin(first)))
        held = rows.withColumn("_first", F.explode(held))
        met = held.join(F.broadcast(named.select(F.col("w")[0].alias("_first"), "title")), "_first").where(~F.array_contains("own", F.col("title")))
        return met.where(one | F.contains("text", "title") & F.regexp("text", _quoted(F.col("title")))).select("chunk_id", "title")
    keys = named.select("title", F.xxhash64(F.slice("w", 1, GRAM)).alias("key"))
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))).otherwise(F.array().cast("array<bigint>"))
    runs = chunks.select("chunk_id", _words(F.col("text")).alias("w")).select("chunk_id", F.explode(F.array_distinct(F.concat(*(run(n + 1) for n in range(GRAM))))).alias("key"))
    met = runs.join(keys, "key").select("chunk_id", "title")
    checked = met.where(~one).join(chunks.select("chunk_id", F.lower("text").alias("text")), "chunk_id").where(F.regexp("text", _quoted(F.col("title")))).select("chunk_id", "title")
    return met.where(one).unionByName(checked).join(chunks.select("chunk_id", F.explode(own).alias("title")), ["chunk_id", "title"], "left_anti")


def graph_mentions(chunks: DataFrame, least: int = 4) -> DataFrame:
    """(src, dst, kind) from chunks to the concepts whose title they hold as whole words, but not under it.

    A word is what Unicode takes for one; a title without any is mentioned nowhere.
    """
    nodes = graph_nodes(chunks).where("kind = 'concept'").select(F.col("id").alias("dst"), F.lower("title").alias("title")).where(F.length("title") >= least)
    nodes = kept(nodes, "concepts")
    hits = _mentioned(chunks, nodes.select("title").distinct())
    return hits.join(F.broadcast(nodes) if nodes.count() <= SENT else nodes, "title").select(F.col("chunk_id").alias("src"), "dst", F.lit("mentions").alias("kind")).distinct()


def related_concepts(contains: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per concept: parent, the names of its sub-concepts, how many chunks it holds, how many elsewhere mention it and the headings they stand under."""
    kinds = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("below"))
    down = contains.join(kinds, "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set(F.when(F.col("below") == "concept", F.col("dst")))).alias("subs"), F.count_if(F.col("below") == "chunk").alias("direct_chunks"))
    up = contains.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    at = nodes.where("kind = 'chunk'").select(F.col("id").alias("src"), F.nullif("heading_path", F.lit("")).alias("topic"))
    said = mentions.join(at, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("mentioned_by"), F.sort_array(F.collect_set("topic")).alias("topics"))
    base = nodes.where("kind = 'concept'").select("id", "title").join(down, "id", "left").join(up, "id", "left").join(said, "id", "left")
    names = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.select("id", "title", "parent", names("subs"), F.size(names("subs")).cast("long").alias("sub_concepts"), count("direct_chunks"), count("mentioned_by"), names("topics"))


def related_concept(concept: str, contains: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The row of ``related_concepts`` that a name means: the concept of that title, else one whose path holds it; the first by path.  No row if there is none."""
    wanted = concept.strip().lower()
    exact = F.lower("title") == wanted
    hit = nodes.where((F.col("kind") == "concept") & (exact | F.contains(F.lower("id"), F.lit(wanted)))).orderBy(~exact, "id").limit(1).select("id")
    return related_concepts(contains, mentions, nodes).join(F.broadcast(hit), "id", "left_semi")


def sample_concepts(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The first concepts by path, to name what there is where a concept is not found."""
    return nodes.where("kind = 'concept'").select(F.col("id").alias("concept")).orderBy("concept").limit(n)


def glossary(nodes: DataFrame) -> DataFrame:
    """(term, id): each concept's title, lower-cased, with the nodes that bear it."""
    return nodes.where("kind = 'concept'").select(F.lower("title").alias("term"), "id").distinct()


def graph_stats(nodes: DataFrame, contains: DataFrame, mentions: DataFrame) -> DataFrame:
    """(what, n): nodes, concepts, edges and cross references."""
    kinds = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "concept").alias("concepts"))
    edges = contains.unionByName(mentions).agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "mentions").alias("cross_references"))
    return kinds.join(edges, F.lit(True)).select(F.explode(F.create_map(*(x for c in ("nodes", "concepts", "edges", "cross_references") for x in (F.lit(c), F.col(c))))).alias("what", "n"))


def synthesize(seeds: DataFrame, contains: DataFrame, mentions: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(rank, chunk_id, why) around seeds (chunk_id, rank): the seeds, chunks of concepts they mention, chunks beside them.

    A chunk is taken for its first reason in that order, by seed, then by id.
    """
    chunk = nodes.where("kind = 'chunk'").select(F.col("id").alias("chunk_id"))
    own = seeds.select("chunk_id", F.lit("vector match").alias("why"), F.col("rank").alias("seed"), F.lit(0).alias("level"))
    of = contains.select(F.col("src").alias("concept"), F.col("dst").alias("to"))
    via = seeds.join(mentions, seeds["chunk_id"] == mentions["src"]).join(of, F.col("concept") == mentions["dst"])
    via = via.select(F.col("to").alias("chunk_id"), F.lit("related concept").alias("why"), F.col("rank").alias("seed"), F.lit(1).alias("level"))
    up = seeds.join(contains, seeds["chunk_id"] == contains["dst"]).join(of, F.col("concept") == contains["src"])
    beside = up.select(F.col("to").alias("chunk_id"), F.lit("same section").alias("why"), F.col("rank").alias("seed"), F.lit(2).alias("level"))
    all_of = own.unionByName(via).unionByName(beside).join(chunk, "chunk_id", "left_semi")
    best = all_of.groupBy("chunk_id").agg(F.min(F.struct("seed", "level", "why")).alias("b")).select("chunk_id", "b.*")
    top = best.orderBy("seed", "level", "chunk_id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy("seed", "level", "chunk_id")).alias("rank"), "chunk_id", "why")


def relations_map(links: DataFrame, docs: DataFrame) -> DataFrame:
    """A Markdown block for each document with links, by path."""
    line = F.concat(F.lit("- [["), F.col("dst_target"), F.lit("]]"), F.when(F.col("dst_document").isNull(), F.lit(" (unresolved)")).otherwise(F.lit("")))
    body = links.groupBy(F.col("src_document").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    return docs.join(body, "id").select("path", F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), F.col("lines"), F.lit("\n")).alias("block"))
