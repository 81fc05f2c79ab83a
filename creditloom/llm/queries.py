"""The registered queries of this subpackage, each a thin wrapper that binds an operator to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, language, quality, runs, secret_scan, sharding, signatures, simhash, sketch, toxicity, trie
from ..scratch import materialise
from .hot import join_counted


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file that the encoding query and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = _read(spark, folder, "conversations").select(*extra.columns).unionByName(extra)
    back = chat.read_chats(chat.format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_CHATS_SQL = r"""with said as (select '<|im_end|><|im_start|>assistant ok' as t),
rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', t from said union all select -1, 1, 'assistant', t from said
),
sized as (
  select *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) as n_text, length(replace(replace(role, '\', '\\'), '<|', '<\|')) as n_role,
    coalesce(lag(role) over w = role, false) as merged
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n_text + case when merged then length('<|im_next|>') else n_role + length('<|im_start|><|im_end|>') + 2 end) as bigint) as formatted_chars
from sized group by conv_id"""


def op4_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = [r.kind for r in secret_scan.BASE]
    return found.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(secret_scan.joined(F.col("spans"), base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def _match_sql(number: int, kind: str, pattern: str, keep: str) -> str:
    """Matches of one kind with their places: the pieces between matches tell where each begins."""
    return f"""select row_id, {number} as k, '{kind}' as kind, b as s, b + length(m) as e from (
    select row_id, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1),
        lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0)
      )) as b
    from (select row_id, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps from texts)
  ) where {keep}"""


_ANY_CASE = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN_SQL = _ANY_CASE + "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SECRETS_SQL = f"""with texts as (select row_number() over () as row_id, doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join([
    _match_sql(0, "assign", _ASSIGN_SQL, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 8"),
    _match_sql(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    _match_sql(2, "hex", "[0-9a-f]+", "length(m) >= 32"),
    _match_sql(3, "github", "gh[opsu]_[A-Za-z0-9]+", "length(m) >= 40"),
    _match_sql(4, "slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
])}),
per as (select row_id,
  count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k) filter (k <= 2) as base,
  string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k) as spans
  from found group by row_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join per using (row_id)"""


def op5_balanced_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.balanced_shards(_read(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "link_group", "linked_rows",
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, _read(spark, folder, "labels")))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_read(spark, folder, "pages"), language.fit(_read(spark, folder, "documents")))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = quality.fit(docs, _read(spark, folder, "labels").filter(~held_out))
    return quality.scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(_read(spark, folder, "documents"), tokenizer_path())
    return coded.select(
        "doc_id", F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.fingerprints(_read(spark, folder, "documents"))


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, numbered from 0, and the conversations: their first turns come from that whose id is a multiple of 5."""
    own = materialise(trie.numbered_turns(conversations))
    heads = own.filter("conv_id % 5 = 0 and place < 8").groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("head"))
    members = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 9)
    taken = F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<place:bigint,role:string,text:string>>)")), F.lit(1), F.col("h").cast("int"))
    members = members.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads.hint("merge"), "base", "left")
    members = materialise(members.select("conv_id", "n", "h", taken.alias("taken")))
    first = members.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    rest = join_counted(own, members.select("conv_id", "n", "h", F.size("taken").alias("n_taken")), ["conv_id"]).filter("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("n_taken")).alias("place"), "role", "text")
    return first.unionByName(rest), members.select("conv_id")


def op11_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_nodes(*_rebuilt(_read(spark, folder, "conversations")))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by a hash of its doc_id, goes on from a word on with a short period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    planted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    with_rule = planted.withColumn("rule", F.when(n > 0, F.struct(a.cast("int").alias("a"), period.cast("int").alias("p"))))
    source = F.transform("words", lambda w, i: F.get(F.col("words"), F.when(i >= F.col("rule.a"), F.col("rule.a") + (i - F.col("rule.a")) % F.col("rule.p")).otherwise(i)))
    return with_rule.select("doc_id", F.when(F.col("rule").isNotNull(), F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(_with_planted_runs(_read(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("*", longest.alias("best"), listed.alias("listed"))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    return f"""xor(4294967295, list_reduce([cast(ascii({text}[i]) as bigint) for i in range(1, length({text}) + 1)],
      lambda c, b: list_reduce(range(0, 8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295))"""


_TRIE_SQL = f"""with turns as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), convs as (
  select conv_id, count(*) as n, conv_id - conv_id % 5 as base, {_crc32_sql("cast(conv_id as varchar)")} % 9 as h from turns group by conv_id
), rebuilt as (
  select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.place < c.h
  union all
  select c.conv_id, t.place - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.place >= c.h left join convs b on b.conv_id = c.base
), paths as (
  select conv_id, place + 1 as depth, strlen(text) as bytes, string_agg(md5(length(role) || ':' || role || text), '') over (partition by conv_id order by place) as path from rebuilt
  union all select conv_id, 0, 0, '' from convs
), nodes as (select path, any_value(depth) as depth, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs from paths group by path),
children as (select left(path, length(path) - 32) as path, count(*) as n_children from nodes where depth > 0 group by 1),
sums as (
  select left(path, cast(32 * above as bigint)) as path, sum((n_convs - 1) * bytes) as saved_tokens, sum(leaf) as n_leaves
  from (select n.path, n_convs, bytes, unnest(range(0, depth + 1)) as above, cast(c.path is null as int) as leaf from nodes n left join children c using (path)) group by 1
), ends as (
  select path, sha256(string_agg(conv_id, ',' order by conv_id)) as ends_sha256
  from (select conv_id, max_by(path, depth) as path from paths group by conv_id) group by path
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from nodes n left join nodes p on n.depth > 0 and p.path = left(n.path, length(n.path) - 32)
  left join children c on c.path = n.path left join sums s on s.path = n.path left join ends e on e.path = n.path"""


_RUNS_SQL = rf"""with texts as (
  select row_number() over () as row_id, doc_id, string_split_regex(trim(coalesce(text, ''), e' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') as ws
  from documents
), plain as (
  select row_id, doc_id, case when ws = [''] then [] else ws end as ws, {_crc32_sql("cast(doc_id as varchar)")} as h from texts
), rules as (select *, len(ws) as n, h // 10 as g from plain),
edited as (
  select row_id, doc_id, n, case when h % 10 = 0 and n > 0
    then [ws[1 + case when i >= g % n then g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) else i end] for i in range(0, n)] else ws end as ws
  from rules
), places as (select row_id, n, unnest(ws) as w, unnest(range(0, n)) as i from edited),
equal_words as (
  select a.row_id, a.i, b.i - a.i as q from places a join places b on a.row_id = b.row_id and a.w = b.w and b.i > a.i and b.i - a.i <= a.n // 4
), stretches as (
  select row_id, q, min(i) as s, count(*) + q as l
  from (select row_id, q, i, i - row_number() over (partition by row_id, q order by i) as island from equal_words) group by row_id, q, island
), runs as (select row_id, s, l, min(q) as q from stretches where l >= greatest(6, 4 * q) group by row_id, s, l),
per as (
  select row_id, count(*) as n_runs, max({{'l': l, 's': -s, 'q': -q}}) as best, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed
  from runs group by row_id
), dropped as (select distinct row_id, unnest(range(s + q, s + l)) as i from runs),
left_over as (select row_id, string_agg(w, ' ' order by i) as short from places anti join dropped using (row_id, i) group by row_id)
select doc_id, coalesce(n_runs, 0) as n_runs, -best.s as start, best.l as length, -best.q as period,
  1000 * best.l // -best.q as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(short, '')) as collapsed_sha256
from edited left join per using (row_id) left join left_over using (row_id)"""


def op13_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = signatures.near_duplicates(_read(spark, folder, "documents"), size=3, similarity=0.85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_NEAR_SQL = r"""with recursive words as (
  select row_number() over () as row_id, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws
  from documents
), sets as (
  select row_id, doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_sort(list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)])) end as shingles
  from words
), nodes as (select min(row_id) as node, shingles, len(shingles) as n from sets where len(shingles) > 0 group by shingles),
posts as (select node, n, unnest(shingles) as shingle from nodes),
common as (
  select a.node as a, b.node as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from posts a join posts b on a.shingle = b.shingle and a.node < b.node
    and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 group by 1, 2
), near as materialized (select a, b from common where 100 * c >= 85 * (na + nb - c)),
links as materialized (select a, b from near union all select b, a from near),
reach as (select node, node as other from nodes union select reach.node, links.b from reach join links on reach.other = links.a), first_ids as (select n.node, min(s.doc_id) as first_id from nodes n join sets s on s.shingles = n.shingles group by n.node),
classes as (select reach.node, min(first_id) as component_id from reach join first_ids on first_ids.node = reach.other group by reach.node),
found as (
  select s.doc_id, len(s.shingles) as n_shingles, case when len(s.shingles) = 0 then s.doc_id else c.component_id end as component_id
  from sets s left join nodes n on s.shingles = n.shingles left join classes c on c.node = n.node
)
select *, doc_id is not distinct from component_id as kept from found"""


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_benchmark_decontamination, op3_chat_formatting, op4_secret_scans, op5_balanced_sharding, op6_toxicity, op7_language_id, op8_quality_classifier, op9_bpe_encoding, op10_document_fingerprints, op11_conversation_prefix_trie, op12_periodic_runs, op13_minhash_near_dedup)}

SQL: dict[str, str] = {"op3_chat_formatting": _CHATS_SQL, "op4_secret_scans": _SECRETS_SQL, "op11_conversation_prefix_trie": _TRIE_SQL, "op12_periodic_runs": _RUNS_SQL, "op13_minhash_near_dedup": _NEAR_SQL}
