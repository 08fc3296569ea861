"""Registered queries of the note and memory operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import dynamic, parsing, text
from noteloom.operators import deltas, digest, evals, graph, memory, notes as note_views, properties, suggest, tasks, templates
from noteloom.operators.budget import greedy
from noteloom.operators.packing import pack
from noteloom.operators.postings import token_counts
from noteloom.operators.index import StoredIndex
from noteloom.operators.search import dense_top_k
from noteloom.plans import oracles, state_queries
from noteloom.plans.oracles import MARKDOWN, QUERY
from noteloom.sources import log
from noteloom.sources.places import Files, shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: id docs/<doc_id>, the first two words as title, language and source as tags."""
    d = table(spark, sf_dir, "documents")
    title = F.regexp_extract("text", r"^([^ \t\n]+[ \t\n]+[^ \t\n]+)", 1)
    return d.select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.array("lang", "source").alias("tags"),
        parsing.links("text").alias("links"),
    )


def place_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as linked notes; a nation links to its region and to the next
    nation, by name only; nations from 20 on link to nothing."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    following = n.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("next"))
    nations = n.join(r, n.n_regionkey == r.r_regionkey).join(following, F.col("n_nationkey") == F.col("k"), "left")
    text_of = F.concat_ws(" ", F.concat(F.lit("[[regions/"), "r_name", F.lit("|in]]")), F.concat(F.lit("[["), F.lower("next"), F.lit("#top]]")))
    made = nations.select(F.concat(F.lit("nations/"), "n_name", F.lit(".md")).alias("path"), F.when(F.col("n_nationkey") < 20, text_of).alias("raw"))
    return parsing.parse_notes(made.union(r.select(F.concat(F.lit("regions/"), "r_name", F.lit(".md")), F.concat(F.lit("# "), "r_name"))))


def markdown_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw): documents as Markdown notes of four kinds, with properties, headings, links, tags, tasks and placeholders about their text."""
    k = F.col("doc_id")
    fields = {
        "id": k, "lang": F.col("lang"), "source": F.col("source"), "next": k + 1, "second": k + 2, "before": k - 1, "last": k - 2, "day": F.lpad((k % 28 + 1).cast("string"), 2, "0"), "text": F.coalesce("text", F.lit("")),
        "open": F.lit("{{"), "close": F.lit("}}"),
    }
    raw = F.lit(None).cast("string")
    for i, note in enumerate(MARKDOWN):
        raw = F.when(k % 4 == i, F.concat(*[fields[p].cast("string") if field else F.lit(p) for field, p in oracles.pieces(note)])).otherwise(raw)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), k.cast("string"), F.lit(".md")).alias("path"), raw.alias("raw"))


def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written first, as notes are: an expression that makes them would be repeated in each of the parser's
    return parsing.parse_notes(written(markdown_raw(spark, sf_dir), "markdown"))


_BUILT: dict[tuple[str, str], StoredIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The stored index of the documents: built by the first query over these files, only read by later ones."""
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in Files(spark, f"{sf_dir}/documents.parquet").status())
    key = (spark.sparkContext.applicationId, "\n".join(files))
    if key not in _BUILT:
        index = StoredIndex(spark, f"{shared_dir(spark)}/noteloom/index-{uuid.uuid4().hex}")
        index.build(document_notes(spark, sf_dir))
        _BUILT[key] = index
    return _BUILT[key]


def conversation_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "project").otherwise("reference")
    author = F.when(F.col("role") == "user", "human").otherwise("agent")
    rows = c.select(
        kind.alias("type"), F.col("text").alias("content"), F.array("role").alias("tags"), F.concat_ws("|", F.col("conv_id").cast("string"), "role").alias("key"),
        F.struct(F.concat(F.lit("turn/"), F.col("turn").cast("string")).alias("origin"), author.alias("author"), F.lit("2024-01-01T00:00:00Z").alias("timestamp")).alias("source"),
        F.lit(None).cast("long").alias("ttl"),
    )
    return memory.with_ids(rows).dropDuplicates(["id"])


def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    return token_counts(table(s, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def token_estimate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))


def stable_ids(s: SparkSession, d: str) -> DataFrame:
    return conversation_memories(s, d).select("id", "type", "key", F.col("source.origin").alias("origin"))


def search_lexical(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).lexical(QUERY).select(F.col("id").alias("note_id"), F.col("lex").cast("long").alias("score"))


def search_semantic(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).ranked(QUERY, "semantic").select(F.col("id").alias("note_id"), "score")


def search_hybrid(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).ranked(QUERY, "hybrid").select(F.col("id").alias("note_id"), "score")


def search_topk_budget(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).search(QUERY, "hybrid", token_budget=400, top_k=20)


def snippets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.snippet(F.lit(QUERY), "text").alias("snippet"))


def fnv_features(s: SparkSession, d: str) -> DataFrame:
    words = token_counts(table(s, d, "documents"), "doc_id", "text").select("token").distinct()
    return words.select("token", F.explode(text.features("token")).alias("feature")).distinct().select("token", "feature", text.fnv1a("feature").alias("hash"), text.bucket("feature").cast("long").alias("bucket"))


def recall_budget(s: SparkSession, d: str) -> DataFrame:
    items, _ = memory.recall(conversation_memories(s, d), QUERY, "user", 900)
    return items.select("id", "content", F.col("score").cast("long").alias("score"), "token_count")


def recall_conflicts(s: SparkSession, d: str) -> DataFrame:
    _, found = memory.recall(conversation_memories(s, d), QUERY)
    return found.select("key", F.array_join("memory_ids", ",").alias("memory_ids"))


def memory_errors(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    code = memory.error_code(
        F.when(F.col("turn") % 5 != 0, "user").otherwise(F.col("role")), F.when(F.col("turn") % 3 == 0, "robot").otherwise("agent"), F.when(F.col("turn") % 7 == 0, " ").otherwise(F.col("text")),
        F.when(F.col("turn") % 4 == 0, "").otherwise("chat"), F.col("role") != "system",
    )
    return c.select("conv_id", "turn", "role", code.alias("code"))


def _event_notes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.concat(F.lit("events/"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("title"), F.try_parse_json("props").alias("frontmatter"))


def props_filter(s: SparkSession, d: str) -> DataFrame:
    f = [dynamic.Filter("k", "gte", 10), dynamic.Filter("k", "lt", 40), dynamic.Filter("k", "ne", 17), dynamic.Filter("zz", "not_exists")]
    return properties.properties_query(_event_notes(s, d), f, ["k"], limit=200, token_budget=1500).select("note_id", "title", "token_count")


def props_sort_desc(s: SparkSession, d: str) -> DataFrame:
    return properties.properties_query(_event_notes(s, d), [dynamic.Filter("k", "exists")], ["k"], "k", True, 75).select("note_id", "title", "properties")


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return dense_top_k(e, e.orderBy("vec_id").limit(1), 25).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def graph_links(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(place_notes(s, d)).select("src", "dst", F.col("pos").cast("long").alias("pos"))


def graph_backlinks(s: SparkSession, d: str) -> DataFrame:
    return graph.graph_query(place_notes(s, d), "regions/ASIA", "backlinks")


def graph_bfs(s: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(graph.edges(place_notes(s, d)), "nations/NATION_7", 3).select("note_id", F.col("depth").cast("long").alias("depth"))


def graph_orphans(s: SparkSession, d: str) -> DataFrame:
    return graph.orphans(place_notes(s, d))


def suggest_links(s: SparkSession, d: str) -> DataFrame:
    index = _index(s, d)
    found = suggest.suggest_links(index.notes(), "docs/1", index=index, top_k=15, min_score=0.2, token_budget=600)
    return found.select("note_id", "title", "score", F.array_join("reasons", ",").alias("reasons"), "snippet", "token_count")


def _retrieved(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "lang", "text")
    hits = memory.lexical_scores(docs, QUERY, "doc_id", "text").where("score >= 5").withColumnRenamed("id", "doc_id")
    return docs.join(hits, "doc_id").select("lang", F.col("doc_id").alias("id"), text.estimate_tokens("text").alias("token_count"))


def _relevant(s: SparkSession, d: str) -> DataFrame:
    good = table(s, d, "labels").where("quality = 1").select("doc_id")
    return table(s, d, "documents").join(good, "doc_id", "left_semi").select("lang", F.col("doc_id").alias("id"))


def eval_prf1(s: SparkSession, d: str) -> DataFrame:
    return evals.prf(_retrieved(s, d), _relevant(s, d), ["lang"])


def token_efficiency(s: SparkSession, d: str) -> DataFrame:
    return evals.token_efficiency(_retrieved(s, d), _relevant(s, d), ["lang"])


def eval_averages(s: SparkSession, d: str) -> DataFrame:
    rounded = evals.averages(evals.prf(_retrieved(s, d), _relevant(s, d), ["lang"]), ["precision", "recall", "f1"])
    return rounded.select(*[F.round(c, 9).alias(c) for c in rounded.columns])


def scan_delta(s: SparkSession, d: str) -> DataFrame:
    keyed = table(s, d, "documents").select(F.concat(F.lit("n:"), F.col("doc_id").cast("string")).alias("key"), F.sha2("text", 256).alias("hash"), "doc_id")
    shadow = keyed.where("doc_id % 2 = 0").select("key", F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(F.col("hash")).alias("hash"))
    gone = shadow.where(F.substring("key", -1, 1) == "4").select(F.concat("key", F.lit("-gone")).alias("key"), "hash")
    return deltas.scan_delta(keyed.select("key", "hash"), shadow.union(gone))


def _log_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("props").alias("body"))


def log_resume(s: SparkSession, d: str) -> DataFrame:
    rows = _log_rows(s, d)
    return log.fresh_rows(rows.union(rows.where("seq % 3 = 0")), 150).select("seq", "body")


def log_compact(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    folded = e.where("event_id <= 500").groupBy("user_id").agg(F.max("event_id").alias("seq")).select("seq", F.lit("snapshot").alias("body"))
    return log.compacted(folded, _log_rows(s, d).select("seq", "body"), 500)


def snapshot_complete(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    parts = e.select((F.col("event_id").cast("long") - F.col("event_id") % 4).alias("upto"), (F.col("event_id") % 4).alias("idx"), F.lit(4).cast("long").alias("of")).where("upto % 16 <> 8 OR idx <> 2")
    return log.complete_snapshots(parts.union(parts))


def _presence_rows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("device"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_type") == "error").alias("gone"), F.col("event_id").alias("seq"), F.col("event_type").alias("note_id"))


def presence_lww(s: SparkSession, d: str) -> DataFrame:
    return deltas.presence_state(_presence_rows(s, d)).select("device", "ts", "note_id", "seq")


def presence_ttl(s: SparkSession, d: str) -> DataFrame:
    rows = _presence_rows(s, d)
    now = rows.agg(F.max("ts")).first()[0] or 0
    return deltas.presence_alive(deltas.presence_state(rows), now, 86_400_000).select("device", "ts")


def _entitlement_events(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "trialing").when(F.col("event_type") == "purchase", "past_due").otherwise("canceled")
    kind = F.when(F.col("event_type") == "error", "subscription.deleted").otherwise("subscription.updated")
    return table(s, d, "events").select(
        F.col("user_id").alias("vault"), "event_id", kind.alias("type"), status.alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created"), (F.col("event_id") * 1000).alias("quota_bytes")
    )


def entitlement_fold(s: SparkSession, d: str) -> DataFrame:
    return deltas.entitlement_fold(_entitlement_events(s, d)).select("vault", "event_id", "status", "quota_bytes")


def quota_join(s: SparkSession, d: str) -> DataFrame:
    usage = table(s, d, "events").groupBy(F.col("user_id").alias("vault")).agg(F.sum(F.length("props") * 1_000_000).cast("long").alias("used"))
    granted = table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("vault"), (F.col("c_custkey") * 1_000_000).cast("long").alias("quota_bytes"))
    return deltas.quota_check(usage, granted)


def version_diff(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("note_id"), F.col("o_orderstatus").alias("raw"), F.col("o_orderkey").alias("k"))
    before = o.where("k % 3 <> 0").select("note_id", "raw")
    after = o.where("k % 5 <> 0").select("note_id", F.concat(F.lit("x"), "raw").alias("raw"))
    return deltas.version_diff(before, after)


def state_vector(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return deltas.state_vector(e.select((F.col("user_id") % 50).alias("item"), F.col("event_type").alias("client"), F.col("event_id").alias("clock")))


def tombstones(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("user_id") % 50).alias("item"), F.col("event_type").alias("client"), F.col("event_id").alias("clock"))
    return deltas.covered(deltas.state_vector(e), deltas.state_vector(e.where("item % 3 <> 0 AND (item % 7 <> 0 OR client <> 'error')")))


def pack_parts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return pack(rows, 20_000, "size", [F.asc("doc_id")]).select("doc_id", "part")


def budget_by_language(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("lang", "doc_id", text.estimate_tokens("text").alias("cost"))
    return greedy(docs, 2500, "cost", [F.desc("cost"), F.asc("doc_id")], ["lang"]).select("lang", "doc_id", "cost")


def note_parse(s: SparkSession, d: str) -> DataFrame:
    n = markdown_notes(s, d)
    heads = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h.level.cast("string"), h.text, h.slug)), ";")
    links = F.array_join(F.transform("links", lambda x: F.concat_ws("|", x.target, F.coalesce(x.heading, F.lit("-")), F.coalesce(x.block, F.lit("-")), F.coalesce(x["alias"], F.lit("-")))), ";")
    return n.select("id", "title", heads.alias("headings"), links.alias("links"), F.array_join("tags", ",").alias("tags"), F.length("content").cast("long").alias("length"))


def task_extract(s: SparkSession, d: str) -> DataFrame:
    found = tasks.list_tasks(markdown_notes(s, d), limit=2_147_483_647)
    return found.select("note_id", F.col("line").cast("long").alias("line"), "text", "done", "due", F.array_join("tags", ",").alias("tags"), "token_count")


def note_outline(s: SparkSession, d: str) -> DataFrame:
    return note_views.get_notes(markdown_notes(s, d), "outline", 6)


def template_schema(s: SparkSession, d: str) -> DataFrame:
    return templates.templates(markdown_notes(s, d).select(F.col("id").alias("name"), "raw")).select("name", F.array_join("vars", ",").alias("vars"))


def vault_digest(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    audit = e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("action"), F.format_string("v_%08d", "event_id").alias("version_id"))
    return digest.digest(markdown_notes(s, d), audit, "2026-08-10")


def queries() -> dict[str, Query]:
    found = [
        tokenize_counts, token_estimate, stable_ids, search_lexical, search_semantic, search_hybrid, search_topk_budget, snippets, fnv_features, recall_budget, recall_conflicts, memory_errors,
        props_filter, props_sort_desc, dense_topk, graph_links, graph_backlinks, graph_bfs, graph_orphans, suggest_links, eval_prf1, token_efficiency, eval_averages, scan_delta,
        log_resume, log_compact, snapshot_complete, presence_lww, presence_ttl, entitlement_fold, quota_join, version_diff, state_vector, tombstones,
        pack_parts, budget_by_language, note_parse, task_extract, note_outline, template_schema, vault_digest,
    ]
    return {f.__name__: f for f in found} | state_queries.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql() | state_queries.oracle_sql()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a hybrid search with top-k and token budget."""
    return search_topk_budget(spark, sf_dir)
