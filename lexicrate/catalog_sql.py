"""DuckDB SQL for the queries of ``catalog``, derived from the raw tables alone."""

from __future__ import annotations

from .functions.analysis import UNICODE_WORD
from .functions.stopwords import stopwords

TOP = 50


def _strings(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SPLIT = r"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"
WHITESPACE = SPLIT.format(text="text")
LOWER = SPLIT.format(text="lower(text)")
WORDS = (
    "list_filter(regexp_extract_all(text, '" + UNICODE_WORD.replace("'", "''") + r"'), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))"
)


def without(tokens: str, lang: str) -> str:
    return f"list_filter({tokens}, lambda x: x not in ({_strings(stopwords(lang))}))"


def bounded(tokens: str, low: int = 1, high: int = 128) -> str:
    return f"list_filter({tokens}, lambda x: length(x) between {low} and {high})"


DEFAULT = bounded(without(LOWER, "en"))


def base(source: str = "select doc_id, text from documents") -> str:
    """Documents, postings, term and corpus statistics as CTEs."""
    return f"""
with docs as (
  select doc_id, toks, len(toks)::bigint as doc_len from (select doc_id, {DEFAULT} as toks from ({source}))
), occ as (
  select doc_id, doc_len, unnest(toks) as term, generate_subscripts(toks, 1) - 1 as pos from docs
), post as (
  select term, doc_id, doc_len, count(*)::bigint as tf from occ group by all
), terms as (
  select term, count(*)::bigint as df, sum(tf)::bigint as cf, max(least(tf, 65535))::bigint as max_tf from post group by term
), stats as (
  select greatest(count(*), 1)::double as n, coalesce(sum(doc_len) / nullif(count(*), 0), 0)::double as avgdl,
         count(*)::bigint as n_docs, coalesce(sum(doc_len), 0)::bigint as total_len from docs
)"""


RIDF = "greatest(0::double, ln(1::double + (n - df + 0.5::double) / (df + 0.5::double)))"
AIDF = "greatest(0::double, ln((n + 1::double) / (df + 0.5::double)))"
LEN = "(0.25::double + 0.75::double * doc_len::double / greatest(avgdl, 0.000001::double))"


def _sat(k1: str, tf: str = "tf::double") -> str:
    return f"({tf} * ({k1} + 1) / ({tf} + {k1} * {LEN}))"


ADAPTIVE_K1 = "least(greatest(0.7::double + ln(1 + greatest(cf::double / n, 0.000001::double)), 0.8::double), 2.2::double)"
SCORES = {
    "okapi": f"{RIDF} * {_sat('1.2::double')} * w",
    "plus": f"{RIDF} * ({_sat('1.2::double')} + 0.5::double) * w",
    "l": f"{RIDF} * 2.2::double * (tf / {LEN} + 1) / (1.2::double + tf / {LEN} + 1) * w",
    "adpt": f"{RIDF} * {_sat(ADAPTIVE_K1)} * w",
    "f": f"{RIDF} * {_sat('1.2::double')} * w",
    "t": f"{RIDF} * {_sat('1.2::double')} * w",
    "atire": f"{AIDF} * {_sat('1.2::double')} * w",
    "tfidf": "tf::double * ln(1::double + n / (df + 1)) * w",
}
PROBE = "(values (0, 'that', 1::double), (0, 'was', 1::double), (0, 'for', 2::double)) q(query_id, term, w)"


def scores(queries: str, score: str = SCORES["okapi"], where: str = "true", name: str = "scores") -> str:
    """CTE of scores by query and document."""
    return f""", {name} as (
  select query_id, doc_id, round(sum({score}), 6) as score
  from post join terms using (term) join {queries} using (term), stats
  where {where} group by query_id, doc_id
)"""


def ranked(k: int = TOP, name: str = "scores", columns: str = "rank, doc_id, score") -> str:
    return f"""
select {columns} from (
  select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {name} where score > 0
) where rank <= {k}"""


def pairs(*terms: tuple[str, float]) -> str:
    rows = ", ".join(f"(0, '{t}', {w}::double)" for t, w in terms)
    return f"(values {rows}) q(query_id, term, w)"


def holds(term: str) -> str:
    return f"doc_id in (select doc_id from post where term = '{term}')"


OKAPI = base() + scores(PROBE) + ranked()
ORACLES: dict[str, str] = {f"score_{k}": base() + scores(PROBE, v) + ranked() for k, v in SCORES.items()}
ORACLES["scored_documents"] = base() + scores(PROBE) + "\nselect doc_id, score from scores"

ITEMS = f"""(
  select item_id as query_id, term, count(*)::double as w
  from (select item_id, unnest({DEFAULT}) as term from benchmark) group by all
) q"""
ORACLES["search_batch_benchmark"] = base() + scores(ITEMS) + ranked(10, columns="query_id, rank, doc_id, score")
ORACLES["search_weighted"] = base() + scores(pairs(("that", 2.5), ("for", 1.25))) + ranked()


def _boolean(terms: list[tuple[str, float]], where: str) -> str:
    return base() + scores(pairs(*terms), where=where) + ranked()


ORACLES["search_boolean_must"] = _boolean(
    [("that", 1), ("was", 1), ("for", 1)], f"{holds('that')} and {holds('was')}"
)
ORACLES["search_boolean_should"] = _boolean([("que", 1), ("was", 1)], "true")
ORACLES["search_boolean_must_not"] = _boolean(
    [("that", 1), ("was", 1)], f"{holds('that')} and {holds('was')} and not {holds('with')}"
)
ORACLES["search_boolean_unknown_must"] = _boolean([("that", 2), ("no_such_term", 1)], holds("that"))
ORACLES["search_boolean_only_must_not"] = _boolean([("that", 1)], "false")


def _phrase(terms: list[str], window: int) -> str:
    steps = [f", p0 as (select doc_id, pos as start, pos from occ where term = '{terms[0]}')"]
    for i, term in enumerate(terms[1:], 1):
        steps.append(f""", p{i} as (
  select p.doc_id, p.start, min(o.pos) as pos from p{i - 1} p join occ o on o.doc_id = p.doc_id
  and o.term = '{term}' and o.pos >= p.pos and o.pos - p.pos <= {window} group by all)""")
    weights: dict[str, float] = {}
    for t in terms:
        weights[t] = weights.get(t, 0) + 1
    where = f"doc_id in (select doc_id from p{len(terms) - 1})"
    return base() + "".join(steps) + scores(pairs(*weights.items()), where=where) + ranked()


ORACLES["search_phrase_w1"] = _phrase(["that", "was"], 1)
ORACLES["search_phrase_w5"] = _phrase(["for", "that", "was"], 5)
ORACLES["search_phrase_repeat"] = _phrase(["que", "que"], 0)

for _name in ("daat", "taat", "wand", "bmw", "maxscore", "pruned"):
    ORACLES[f"strat_{_name}_topk"] = OKAPI
ORACLES["strat_wand_walk"] = OKAPI
ORACLES["strat_maxscore_tfidf"] = ORACLES["score_tfidf"]


def _counts(tokens: str, source: str = "documents") -> str:
    return f"select term, count(*)::bigint as n from (select unnest({tokens}) as term from {source}) group by term"


def _grams(parts: str, n: int, glue: str) -> str:
    return (
        f"list_transform(range(1, greatest(len({parts}) - {n - 1}, 0) + 1), "
        f"lambda i: array_to_string(({parts})[i:i + {n - 1}], '{glue}'))"
    )


ORACLES["tok_whitespace_counts"] = _counts(bounded(WHITESPACE))
ORACLES["tok_regex_counts"] = _counts(bounded("list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))"))
ORACLES["tok_unicode_counts"] = _counts(bounded(f"list_transform({WORDS}, lambda x: lower(x))"))
ORACLES["tok_char_ngrams"] = _counts(
    "list_concat(" + ", ".join(
        f"list_transform(range(1, greatest(length(text) - {n - 1}, 0) + 1), lambda i: substr(text, i::int, {n}))" for n in (2, 3)
    ) + ")"
)
ORACLES["tok_word_ngrams"] = _counts(
    bounded("list_concat(" + ", ".join(_grams("words", n, " ") for n in (2, 3)) + ")"),
    f"(select list_transform({WORDS}, lambda x: lower(x)) as words from documents)",
)
ORACLES["tok_pipeline_default"] = _counts(DEFAULT)
for _lang in ("en", "fr", "de", "es"):
    ORACLES[f"flt_stopwords_{_lang}"] = _counts(bounded(without(LOWER, _lang)))
ORACLES["flt_length"] = _counts(bounded(bounded(LOWER, 3, 6)))
ORACLES["flt_duplicate_cap"] = f"""
select term, sum(least(n, 3))::bigint as n from (
  select doc_id, term, count(*) as n from (select doc_id, unnest({LOWER}) as term from documents) group by all
) where length(term) between 1 and 128 group by term"""

ORACLES["idx_doc_lengths"] = base() + "\nselect doc_id, doc_len from docs"
ORACLES["idx_term_stats"] = base() + "\nselect term, df as doc_freq, cf as collection_freq, max_tf from terms"
TERM_IDS = """, firsts as (
  select term, min(struct_pack(d := doc_id, p := pos)) as f from occ group by term
), ids as (
  select term, row_number() over (order by f) - 1 as term_id from firsts
)"""
ORACLES["idx_term_ids"] = base() + TERM_IDS + "\nselect term, term_id, df as doc_freq from ids join terms using (term)"
ORACLES["idx_postings"] = base() + """
select term, doc_id, count(*)::bigint as tf, string_agg(pos::varchar, ',' order by pos) as positions
from occ where term in ('that', 'was', 'que') group by term, doc_id"""
ORACLES["idx_corpus_stats"] = base() + """
select n_docs, total_len, round(avgdl, 6) as avgdl, (select count(*) from terms)::bigint as vocabulary_size from stats"""
ORACLES["idx_blocks"] = base() + """
select term, block_no, min(doc_id) as start_doc_id, max(doc_id) as end_doc_id, max(tf)::bigint as max_tf, count(*)::bigint as n
from (select *, ((row_number() over (partition by term order by doc_id) - 1) // 64)::bigint as block_no from post)
group by term, block_no"""

LIVE = "select doc_id, text from documents where doc_id % 7 <> 0"
ORACLES["delete_then_search"] = base(LIVE) + scores(PROBE) + ranked()
ORACLES["compact_stats"] = base(LIVE) + """
select n_docs, total_len, round(avgdl, 6) as avgdl, (select count(*) from terms)::bigint as vocabulary_size,
       (select sum(df) from terms)::bigint as total_terms, (select max(max_tf) from terms)::bigint as max_tf from stats"""
ORACLES["wal_replay_search"] = base("""
  select doc_id::varchar as doc_id, text from documents where doc_id % 7 <> 0
  union all select 'c-' || conv_id::varchar, text from conversations where turn = 0""") + scores(PROBE) + ranked()

FEEDBACK = scores(PROBE) + """, best as (
  select doc_id from scores where score > 0 order by score desc, doc_id limit 10
), feedback as (
  select doc_id, term, tf::double as w from post where doc_id in (select doc_id from best)
), q as (select * from (values ('that', 1::double), ('was', 1::double), ('for', 2::double)) v(term, w))"""


def _merged(rows: str) -> str:
    return base() + FEEDBACK + f""", rows as ({rows})
select term, round(sum(w) / (select sum(abs(w)) from rows), 6) as weight from rows group by term"""


def _appended(value: str, factor: str) -> str:
    return f"""select term, w from q union all
  select * from (select term, sum({value}) * {factor} as w from feedback group by term order by sum({value}) desc, term limit 10)"""


ORACLES["expand_rm3"] = _merged(_appended("w", "0.5::double"))
ORACLES["expand_bo1"] = _merged(_appended("ln(2 + w)", "1::double"))
ORACLES["expand_rocchio"] = _merged("""
  select term, sum(w) as w from (
    select term, w from q union all
    select term, sum(w) * 0.75::double / (select count(distinct doc_id) from feedback) from feedback group by term
  ) group by term order by sum(w) desc, term limit 10""")
ORACLES["expand_synonym"] = """
with q as (select * from (values ('that', 1::double), ('was', 1::double), ('for', 2::double)) v(term, w)),
s as (select * from (values ('that', 'which'), ('that', 'who'), ('was', 'is')) v(term, synonym)),
rows as (select term, w from q union all select synonym, w * 0.4::double from q join s using (term))
select term, round(w / (select sum(abs(w)) from rows), 6) as weight from rows"""
ORACLES["expand_prf"] = base() + FEEDBACK + """
select term, 1.5::double as weight from q union all
select term, round(0.9::double / row_number() over (order by total desc, term), 6) from (
  select term, sum(f.w * (ln((n_docs + 1::double) / (df + 1::double)) + 1)) as total
  from feedback f join terms using (term), stats
  where term not in ('of', 'the') and term not in (select term from q)
  group by term order by total desc, term limit 8)"""

LISTS = (
    base() + scores(PROBE, SCORES["okapi"], name="s1") + scores(PROBE, SCORES["tfidf"], name="s2")
    + "".join(f""", l{i} as (
  select * from (select query_id, doc_id, score, row_number() over (order by score desc, doc_id) as pos from s{i} where score > 0)
  where pos <= {TOP})""" for i in (1, 2))
)
ORACLES["fuse_rrf"] = LISTS + """, scores as (
  select 0 as query_id, doc_id, round(sum(1::double / (60 + pos)), 6) as score
  from (from l1 union all from l2) group by doc_id)""" + ranked(1000)
ORACLES["fuse_linear"] = LISTS + """, scores as (
  select 0 as query_id, doc_id, round(0.6::double * coalesce(a.score, 0) + 0.4::double * coalesce(b.score, 0), 6) as score
  from l1 a full join l2 b using (doc_id))""" + ranked(1000)
ORACLES["norm_minmax"] = LISTS + """
select doc_id, round((score - min(score) over ()) / (max(score) over () - min(score) over ()), 6) as score from l1"""
ORACLES["norm_zscore"] = LISTS + """
select doc_id, round((score - avg(score) over ()) / stddev_pop(score) over (), 6) as score from l1"""
ORACLES["norm_cdf"] = LISTS + """
select doc_id, round((row_number() over (order by score, pos) - 1) / greatest(count(*) over () - 1, 1)::double, 6) as score from l1"""

JUDGED = """(select * from (values (1, 'that', 1::double), (2, 'was', 1::double), (3, 'que', 1::double), (4, 'no_such_term', 1::double))
  v(query_id, term, w)) q"""


def _measures(i: str, k: int) -> str:
    """CTEs of all metrics by query for the scores in ``s{i}``."""
    return f""", r{i} as (
  select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s{i} where score > 0)
  where rank <= {k}
), h{i} as (
  select query_id, rank, row_number() over (partition by query_id order by rank) as so_far
  from r{i} where doc_id in (select doc_id from labels where quality = 1)
), m{i} as (
  select query_id, coalesce(sum(case when rank <= 10 then 1 / log2(rank + 1) end), 0) as dcg,
         coalesce(sum(case when rank <= 10 then so_far / rank end), 0) as precisions,
         count(*) filter (where rank <= 10) as hits, coalesce(1::double / min(rank), 0) as rr
  from h{i} group by query_id
), e{i} as (
  select query_id, coalesce(dcg, 0) / ideal as ndcg, coalesce(precisions, 0) / depth as ap,
         coalesce(hits, 0) / n_rel::double as recall, coalesce(hits, 0) / 10::double as precision, coalesce(rr, 0) as mrr
  from (values (1), (2), (3), (4)) v(query_id) left join m{i} using (query_id), rel
)"""


REL = """, rel as (
  select count(distinct doc_id) as n_rel, least(count(distinct doc_id), 10) as depth,
         list_sum(list_transform(range(1, least(count(distinct doc_id), 10) + 1), lambda i: 1 / log2(i + 1))) as ideal
  from labels where quality = 1
)"""
ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in ("ndcg", "ap", "recall", "precision", "mrr"))
MEANS = ", ".join(f"round(avg({c}), 6) as {c}" for c in ("ndcg", "ap", "recall", "precision", "mrr"))
ORACLES["metrics_by_query"] = (
    base() + REL + scores(JUDGED, name="s1") + _measures("1", 20)
    + f"\nselect query_id::bigint as query_id, {ROUNDED} from e1"
)
TAGS = {"okapi": "Okapi", "plus": "Plus", "l": "L", "adpt": "Adpt", "f": "F", "t": "T", "atire": "Atire", "tfidf": "TfIdf"}
ORACLES["variant_comparison"] = (
    base() + REL
    + "".join(scores(JUDGED, v, name=f"s{k}") + _measures(k, 10) for k, v in SCORES.items())
    + "\n" + " union all ".join(f"select '{TAGS[k]}' as variant, {MEANS} from e{k}" for k in SCORES)
)
ORACLES["latency_percentiles"] = "select event_type, " + ", ".join(
    f"v[(floor((len(v) - 1) * {p}::double + 0.5::double))::bigint + 1] as p{n}"
    for n, p in ((50, 0.5), (95, 0.95), (99, 0.99), (999, 0.999))
) + " from (select event_type, list_sort(list(value)) as v from events where value is not null group by event_type)"

ORACLES["sparse_query_vector"] = base() + TERM_IDS + f"""
select query_id, term_id, round(w * {RIDF}, 6) as weight
from {ITEMS} join ids using (term) join terms using (term), stats"""
ORACLES["sparse_doc_vector"] = base() + TERM_IDS + "\nselect doc_id, term_id, tf::double as weight from post join ids using (term)"
ORACLES["export_corpus"] = """
select '{"_id":' || to_json(doc_id::varchar) || ',"title":null,"text":' || to_json(text) || '}' as line from documents"""
