"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, chat, decontaminate, divergence, language_model, manifest, mixing, nearest, sharding, simhash, spans, toxicity, url_filter
from .common import crc_mod, new_path, stored, table

URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.with_host_and_path(table(spark, sf_dir, "pages").select("page_id", "url"))
    return url_filter.judge(pages.drop("url"), URL_RULES)


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"), (decontaminate.n_hit() > 0).alias("contaminated"),
    )


def recurrent_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~language_model.held_out())
    return scored.select("doc_id", language_model.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.col("html").alias("payload"),
        F.date_format(F.timestamp_seconds(F.col("page_id") + 1_600_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
    )
    path = new_path(spark, "warc")
    archive.write_archives(captures, path)
    merged = archive.merge_runs(archive.read_runs(spark, path))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stored(simhash.fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "simhash-marks")
    groups = simhash.near_duplicates(marked)
    return marked.join(groups, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents")).drop("text").withColumnRenamed("kept_text", "text")


def weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.manifest(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0)
    return made.withColumnRenamed("proof", "proof_sha256")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = spark.sql("""
        SELECT conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
        FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)
    """)
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(fixture)
    read = chat.read_back(chat.render(chat.reconstruct(chat.log_of(conversations))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filters,
    "op2_recurrent_lm_scores": recurrent_lm_scores,
    "op3_benchmark_decontamination": benchmark_decontamination,
    "op4_warc_archive": warc_archive,
    "op5_karmarkar_karp_sharding": karmarkar_karp_sharding,
    "op6_simhash_near_dedup": simhash_near_dedup,
    "op7_multiprobe_neighbours": multiprobe_neighbours,
    "op8_sentence_span_dedup": sentence_span_dedup,
    "op9_weak_toxicity": weak_toxicity,
    "op10_entropy_mixing": entropy_mixing,
    "op11_source_divergence": source_divergence,
    "op12_merkle_manifest": merkle_manifest,
    "op13_chat_formatting": chat_formatting,
}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r.name))
_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
_ESCAPED = "replace({}, '\\', '\\\\')"
for _control in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}\\{_control[1:]}')"
#: crc32 of a text of ASCII characters, bit by bit.
_CRC_BIT = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr({0}, CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END)"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), CAST(range(8 * len({0})) AS UBIGINT[])), lambda c, i: "
    f"CAST(xor({_CRC_BIT} >> 1, 3988292384 * ({_CRC_BIT} & 1)) AS UBIGINT)))"
)


def _merkle_sql() -> str:
    """The manifest level by level: five levels for a source, three above; enough for a million rows a source."""
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    leaf = lambda text: "sha256(concat(" + ", ".join([*map(told, manifest.FIELDS[:-1]), told(text)]) + "))"
    lowered = _LOWER.format("text")
    crc = _CRC.format("CAST(doc_id AS VARCHAR)")
    parts = [
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS shown FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n, leaf AS digest FROM l)",
    ]
    climb = lambda t, i: f"{t}{i + 1} AS (SELECT source, k // 16 AS k, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY k)) AS digest FROM {t}{i} WHERE n > 1 GROUP BY source, k // 16, n)"
    done = lambda t, height: " UNION ALL ".join(f"SELECT source, digest FROM {t}{i} WHERE n = 1" for i in range(height + 1))
    parts += [climb("a", i) for i in range(5)] + [f"subroots AS ({done('a', 5)})"]
    parts.append("b0 AS (SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n, digest, source AS name FROM subroots)")
    parts += [climb("b", i) for i in range(3)] + [f"summit AS ({done('b', 3)})"]
    parts.append("""w0 AS (
        SELECT doc_id, leaf, a0.source, a0.k, b0.k AS s, b0.digest AS subroot, summit.digest AS root, shown AS fold, '' AS proof
        FROM a0 JOIN b0 ON a0.source IS NOT DISTINCT FROM b0.name CROSS JOIN summit)""")
    steps = [("a", i, "k") for i in range(5)] + [("b", i, "s") for i in range(3)]
    for at, (t, i, k) in enumerate(steps):
        same = "w.source IS NOT DISTINCT FROM r.source AND " if t == "a" else ""
        left = f"coalesce(array_to_string(ds[1:({k} // {16**i}) % 16], ''), '')"
        right = f"coalesce(array_to_string(ds[({k} // {16**i}) % 16 + 2:], ''), '')"
        parts.append(f"""w{at + 1} AS (
            SELECT doc_id, leaf, w.source, k, s, subroot, root, CASE WHEN ds IS NULL THEN fold ELSE sha256(concat({left}, fold, {right})) END AS fold,
                concat(proof, {left}, {right}) AS proof
            FROM w{at} w LEFT JOIN (SELECT source, k // 16 AS run, list(digest ORDER BY k) AS ds FROM {t}{i} WHERE n > 1 GROUP BY source, k // 16) r
            ON {same}r.run = {k} // {16 ** (i + 1)})""")
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM w{len(steps)}"""


SQL: dict[str, str] = {
    "op1_url_filters": f"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
            SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1)")} AS host,
                regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
            FROM u
        )
        SELECT page_id, host, path,
            CASE {" ".join(f"WHEN {_FITS.format(r.host, r.path)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule,
            CASE {" ".join(f"WHEN {_FITS.format(r.host, r.path)} THEN '{r.verdict}'" for r in _BY_LENGTH)} ELSE 'allow' END AS verdict
        FROM p
    """,
    "op3_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
        starts AS (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
        windows AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS s FROM starts),
        places AS (
            SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
            FROM d, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m
        ),
        hits AS (
            SELECT p.doc_id, p.i, p.m, w.item_id FROM places p JOIN windows w ON p.m = w.m AND array_to_string(p.ws[p.i:p.i + p.m - 1], ' ') = w.s
        ),
        covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
    """,
    "op4_warc_archive": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT p.page_id, payload_bytes, p.payload_digest,
            CASE WHEN first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_id <> p.page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
    """,
    "op13_chat_formatting": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        f AS (SELECT *, length({_ESCAPED.format("text")}) + length(replace({_ESCAPED.format("role")}, chr(10), concat('\\', chr(10)))) AS written FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(written + {len(chat.START) + 1 + len(chat.END)}) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id
    """,
    "op12_merkle_manifest": _merkle_sql(),
    "op11_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ),
        w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(total) AS words FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT lang, source, coalesce(sum(n), 0) AS words FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.words + 2 * v.v) AS p,
                1 + (1000000000 * (k.total + 2)::HUGEINT) // (v.words + 2 * v.v) AS q
            FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        s AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
        ),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
