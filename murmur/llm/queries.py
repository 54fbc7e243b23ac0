"""The dealt operators as queries over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.ann import nearest
from murmur.llm.chat import chat_windows, read_back
from murmur.llm.lexical import lexical_search
from murmur.llm.mixing import mix, n_words
from murmur.llm.near_dedup import near_dedup
from murmur.llm.packing import best_fit_packing
from murmur.llm.periodic import periodic_runs, planted
from murmur.llm.spotsigs import CHAIN, COMMON, DIGITS, fingerprints
from murmur.llm.substring_dedup import substring_dedup
from murmur.llm.token_counts import sample_edits, token_counts
from murmur.llm.toxicity import toxicity
from murmur.llm.url_filter import labelled_by_rules, url_filter
from murmur.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies on four-word runs; see the contract in the README."""
    return near_dedup(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url, learned from the urls that the rules decide."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter(pages, labelled_by_rules(pages))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left without the 13-word windows of earlier documents."""
    return substring_dedup(_table(spark, sf_dir, "documents"), min_words=13)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all others."""
    return nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole texts, learned from confirmed and unlabelled ones."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole texts before and after three edits each."""
    docs = _table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), sample_edits(F.col("text"), F.col("source")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    return warc_round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mix(_table(spark, sf_dir, "documents"), n_words(F.col("text")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and of their edited forms."""
    return fingerprints(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each benchmark item."""
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


#: Both texts of the conversation that the query adds, numbered -7.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the training strings of all conversations hold, read back from them."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    added = spark.createDataFrame(added, "conv_id long, turn long, role string, text string")
    # the digests need each conversation whole
    return read_back(chat_windows(rows.unionByName(added), together=True))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, of which one in ten gets one planted."""
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs, least=24)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_url_filter,
        op3_substring_dedup,
        op4_ann,
        op5_toxicity,
        op6_token_counts,
        op7_warc,
        op8_source_mixing,
        op9_best_fit_packing,
        op10_spotsigs,
        op11_lexical_search,
        op12_chat_format,
        op13_periodic_runs,
    )
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TERMS = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_LIKE = """case when len({a}) + len({b}) = 0 then 1.0::double
    else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end"""

ORACLE = {
    "op1_minhash_near_dedup": rf"""
        with recursive w as (select doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} as w from documents),
        sets as (
            select doc_id, list_distinct(case when len(w) >= 4
                then list_transform(range(1, len(w) - 2), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
                when len(w) > 0 then [hash(array_to_string(w, ' '))] else [] end) as s
            from w),
        every as (select doc_id, len(s) as n, unnest(s) as g from sets),
        shared as (select g from every group by g having count(*) > 1),
        runs as materialized (select * from every semi join shared using (g)),
        links as (
            select a.doc_id as a, b.doc_id as b from runs a join runs b on a.g = b.g and a.doc_id <> b.doc_id
            group by all having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach as (select doc_id, doc_id as seen from sets union select r.doc_id, l.b from reach r join links l on l.a = r.seen)
        select s.doc_id, len(any_value(s.s)) as n_shingles, min(r.seen) as component_id, min(r.seen) = s.doc_id as kept
        from sets s join reach r using (doc_id) group by s.doc_id""",
    "op3_substring_dedup": rf"""
        with w as materialized (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
        windows as materialized (
            select doc_id, unnest(range(1, len(w) - 11)) as i,
                unnest(list_transform(range(1, len(w) - 11), lambda i: hash(array_to_string(w[i:i + 12], ' ')))) as g
            from w where len(w) >= 13),
        firsts as (select g, min(doc_id) as first from windows group by g having count(*) > 1),
        gone as (
            select distinct doc_id, unnest(range(i, i + 13)) as i
            from windows join firsts using (g) where first < doc_id),
        words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w),
        kept as (
            select doc_id, string_agg(word, ' ' order by i) as k, count(*) as n
            from words anti join gone using (doc_id, i) group by doc_id)
        select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256
        from w left join kept using (doc_id)""",
    "op10_spotsigs": f"""
        with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
        nexts as (
            select doc_id, text, n, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as follows,
                coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as next_id
            from d),
        edits as (select *, text[1:n - n // 4] || follows[1:n // 4] as edited from nexts),
        texts as (select doc_id, 0 as form, text as t from edits union all select doc_id, 1, edited from edits),
        w as (select doc_id, form, {WORDS.format("t")} as w from texts),
        places as (select doc_id, form, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from w),
        kinds as (select *, {LOWER.format("w")} in ({", ".join(f"'{c}'" for c in COMMON)}) as common from places),
        after as (select *, lag(common) over (partition by doc_id, form order by i) as after from kinds),
        chains as (
            select doc_id, form, after, {" || ' ' || ".join(["w", *(f"lead(w, {k}) over (partition by doc_id, form order by i)" for k in range(1, CHAIN))])} as c
            from after where not common),
        found as (select doc_id, form, md5(c)[1:{DIGITS}] as s from chains where after and c is not null),
        alone as (select doc_id, form, md5(array_to_string(w, ' '))[1:{DIGITS}] as s from w
            where len(w) > 0 and not exists (select 1 from found f where f.doc_id = w.doc_id and f.form = w.form)),
        sets as (
            select doc_id, form, coalesce(list_sort(list_distinct(list(s) filter (s is not null))), []) as s
            from texts left join (from found union all from alone) using (doc_id, form) group by all),
        three as (
            select e.doc_id, e.n, e.edited, a.s as a, b.s as b, c.s as c from edits e
            join sets a on a.doc_id = e.doc_id and a.form = 0 join sets b on b.doc_id = e.doc_id and b.form = 1
            join sets c on c.doc_id = e.next_id and c.form = 0)
        select doc_id, n as n_chars, sha256(edited) as edited_sha256, array_to_string(a, '') as fingerprint,
            array_to_string(b, '') as edited_fingerprint, {_LIKE.format(a="a", b="b")} as near_edited,
            {_LIKE.format(a="a", b="c")} as near_next, len(a) as n_signatures
        from three""",
    "op11_lexical_search": rf"""
        with d as (select doc_id, {TERMS} as t from documents),
        total as (select count(*) as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0),
        q as (select item_id, unnest({TERMS}) as term from benchmark),
        asked as (select item_id, term, count(*) as times from q group by all),
        tf as (select doc_id, len(t) as n, term, count(*) as tf from (select doc_id, t, unnest(t) as term from d) semi join asked using (term) group by all),
        w as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by term, n_docs),
        scored as (
            select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
            from asked join tf using (term) join w using (term), total group by all)
        select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
        from scored where score > 0 qualify rank <= 10""",
}
