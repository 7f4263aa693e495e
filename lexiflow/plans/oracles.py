"""DuckDB SQL for every checked query key (the independent oracle).

The driver registers ``documents``, ``labels`` (and the other tables) as
views; the fixture views of ``plans/fixtures.py`` are re-stated here as
CTEs, and each key's SQL pulls in the CTEs it needs.  Rules that keep the
two engines equal: explicit whitespace classes (no ``\\s``), integers for
thresholds and allocations, ``||`` for null-propagating concatenation,
counts cast to BIGINT, doubles rounded to 6 digits.
"""

from __future__ import annotations

from lexiflow.functions.labels import INT_TEXT
from lexiflow.functions.text import INT_WS_CLASS, TOKEN_PATTERN, WS_CLASS
from lexiflow.plans.fixtures import FILE_BLOCK, SNS_FROM_SOURCE

_CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    _CTES[name] = (deps, sql)


def with_ctes(body: str, deps: list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as (\n{_CTES[n][1]}\n)" for n in order) + "\n" + body


def parse_sql(x: str) -> str:
    return f"(case when regexp_matches({x}, '{INT_TEXT}') then try_cast(regexp_replace({x}, '{INT_WS_CLASS}', '', 'g') as integer) end)"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS_CLASS}+', ' ', 'g'))"


def token_count_sql(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '{TOKEN_PATTERN}')) + 2)"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN_PATTERN}')"


REMAP_SQL = "(case label_int when -1 then 0 when 0 then 1 when 1 then 2 end)"
NAME_SQL = "(case {x} when 0 then '부정' when 1 then '중립' when 2 then '긍정' end)"

_TOP = f"(case when cast(substr(d.source, 4) as integer) < {SNS_FROM_SOURCE} then 'shop' else 'sns' end)"

cte(
    "reviews",
    [],
    f"""select cast(d.doc_id as varchar) as review_index, d.text as raw_text,
  case when d.doc_id % 3 = 0 then 'sns' else 'shop' end as source,
  d.lang as domain, d.source as main_category,
  'item-' || d.lang || '-' || d.source as product_name,
  cast(l.quality - l.toxic as varchar) as polarity,
  {_TOP} || '/' || d.source || '/' || d.lang || '/part-' || lpad(cast(d.doc_id // {FILE_BLOCK} as varchar), 5, '0') || '.json' as file_path,
  {_TOP} as top_folder,
  d.doc_id as pos
from documents d left join labels l on d.doc_id = l.doc_id""",
)

cte(
    "reviews_dirty",
    ["reviews"],
    """select case when pos % 71 = 0 then null else cast(pos % 7 as varchar) end as review_index,
  case when pos % 97 = 0 then '   '
       when pos % 101 = 0 then null
       when pos % 5 = 0 then '  ' || raw_text || chr(12288) || chr(10) || ' '
       when pos % 13 = 0 then raw_text || chr(28) || chr(160) || chr(128512) || chr(8233) || 'x'
       else raw_text end as raw_text,
  source,
  case when pos % 89 = 0 then null else domain end as domain,
  main_category, product_name,
  case when pos % 53 = 0 then 'x' when pos % 59 = 0 then '7' when pos % 61 = 0 then '1.5' else polarity end as polarity,
  file_path, top_folder, pos
from reviews""",
)

cte(
    "predictions",
    [],
    """select d.doc_id, l.quality - l.toxic + 1 as label,
  case when d.n_chars < 600 then 0 when d.n_chars < 1200 then 1 else 2 end as pred_a,
  case when d.n_chars < 300 then 1 else 2 end as pred_b,
  cast(1200 - d.n_chars as double) / 1000.0 as s0, 0.5 as s1, cast(d.n_chars - 1800 as double) / 1000.0 as s2
from documents d join labels l on d.doc_id = l.doc_id""",
)

cte(
    "predictions_long",
    ["predictions"],
    """select 'a' as run, doc_id, label, pred_a as pred from predictions
union all
select 'b' as run, doc_id, label, pred_b as pred from predictions""",
)


def _prep_chain(src: str, p: str) -> None:
    """staged / prepared CTEs over ``src`` with name prefix ``p``."""
    cte(f"{p}_labelled", [src], f"select *, {parse_sql('polarity')} as label_int from {src} where polarity is not null")
    cte(
        f"{p}_uid",
        [f"{p}_labelled"],
        f"select *, coalesce(file_path, 'nan') || '::' || coalesce(review_index, 'nan') as uid from {p}_labelled",
    )
    cte(
        f"{p}_dedup",
        [f"{p}_uid"],
        f"select * exclude (rn) from (select *, row_number() over (partition by uid order by file_path, pos) as rn from {p}_uid) where rn = 1",
    )
    cte(f"{p}_staged", [f"{p}_dedup"], f"select *, {clean_sql('raw_text')} as text, {REMAP_SQL} as label from {p}_dedup")
    cte(
        f"{p}_prepared",
        [f"{p}_staged"],
        f"select uid, text, label, label_int as polarity, domain, main_category, source from {p}_staged where length(text) > 0 and label is not null",
    )


_prep_chain("reviews", "r")
_prep_chain("reviews_dirty", "rd")
cte("prepared", ["r_prepared"], "select * from r_prepared")

cte(
    "lens",
    ["reviews"],
    "select *, cast(length(raw_text) as integer) as text_len from reviews where raw_text is not null",
)

cte(
    "lab",
    ["reviews"],
    f"select *, {parse_sql('polarity')} as label_int from reviews",
)
cte(
    "lab_dirty",
    ["reviews_dirty"],
    f"select *, {parse_sql('polarity')} as label_int from reviews_dirty",
)


def r6(x: str) -> str:
    return f"round({x}, 6)"


def _describe(src: str, col: str) -> str:
    return f"""select count({col}) as count, {r6(f'avg({col})')} as mean, {r6(f'stddev_samp({col})')} as std,
  cast(min({col}) as double) as min,
  {r6(f'quantile_cont({col}, 0.25)')} as p25, {r6(f'quantile_cont({col}, 0.5)')} as p50, {r6(f'quantile_cont({col}, 0.75)')} as p75,
  cast(max({col}) as double) as max
from {src}"""


def _quantiles(src: str, col: str) -> str:
    qs = [(0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")]
    parts = ", ".join(f"{r6(f'quantile_cont({col}, {q})')} as {n}" for q, n in qs)
    return f"select {parts} from {src}"


def _group_stats(src: str, by: str, col: str, qs: list[tuple[float, str]]) -> str:
    parts = ", ".join(f"{r6(f'quantile_cont({col}, {q})')} as {n}" for q, n in qs)
    return f"""select {by}, count({col}) as count, {r6(f'avg({col})')} as mean, {r6(f'quantile_cont({col}, 0.5)')} as median,
  {parts}, max({col}) as max
from {src} where {by} is not null group by {by}"""


def _box(src: str, by: str, col: str) -> str:
    return f"""with q as (
  select {by}, count({col}) as n, quantile_cont({col}, 0.25) as q1, quantile_cont({col}, 0.5) as median, quantile_cont({col}, 0.75) as q3
  from {src} where {by} is not null and {col} is not null group by {by}
), w as (
  select q.{by}, q.n, q.q1, q.median, q.q3,
    min(case when s.{col} >= q.q1 - 1.5 * (q.q3 - q.q1) then s.{col} end) as lo,
    max(case when s.{col} <= q.q3 + 1.5 * (q.q3 - q.q1) then s.{col} end) as hi
  from {src} s join q on s.{by} = q.{by}
  group by q.{by}, q.n, q.q1, q.median, q.q3
)
select {by}, n, {r6('q1')} as q1, {r6('median')} as median, {r6('q3')} as q3,
  {r6('least(coalesce(cast(lo as double), q1), q1)')} as whislo,
  {r6('greatest(coalesce(cast(hi as double), q3), q3)')} as whishi
from w"""


def _nested(body: str) -> str:
    """Turn a query that starts with its own ``with`` into a subquery."""
    return f"select * from ({body})"


ORACLES: dict[str, str] = {}


def oracle(key: str, deps: list[str], body: str) -> None:
    ORACLES[key] = with_ctes(body, deps)


# ---- profile over reviews -------------------------------------------------
oracle("label_counts", ["lab"], "select label_int, count(*) as n from lab group by label_int")
oracle("domain_counts", ["reviews"], "select domain, count(*) as n from reviews where domain is not null group by domain")
oracle("source_counts", ["reviews"], "select source, count(*) as n from reviews where source is not null group by source")
oracle(
    "crosstab_folder_source",
    ["reviews"],
    """select top_folder, cast(count(*) filter (where source = 'shop') as bigint) as shop,
  cast(count(*) filter (where source = 'sns') as bigint) as sns
from reviews where top_folder is not null and source is not null group by top_folder""",
)
for _key, _by in (("label_share_by_source", "source"), ("label_share_by_domain", "domain")):
    oracle(
        _key,
        ["lab"],
        f"""select {_by}, label_int, n, {r6(f'n * 100.0 / sum(n) over (partition by {_by})')} as pct
from (select {_by}, label_int, count(*) as n from lab where {_by} is not null and label_int is not null group by {_by}, label_int)""",
    )
oracle("length_describe", ["lens"], _describe("lens", "text_len"))
oracle("length_quantiles", ["lens"], _quantiles("lens", "text_len"))
oracle("length_stats_by_domain", ["lens"], _group_stats("lens", "domain", "text_len", [(0.75, "p75"), (0.9, "p90")]))
oracle("length_stats_by_category", ["lens"], _group_stats("lens", "main_category", "text_len", [(0.75, "p75"), (0.9, "p90")]))
oracle("box_by_domain", ["lens"], _nested(_box("lens", "domain", "text_len")))
oracle("box_by_category", ["lens"], _nested(_box("lens", "main_category", "text_len")))
oracle("box_by_source", ["lens"], _nested(_box("lens", "source", "text_len")))
oracle(
    "length_histogram",
    ["lens"],
    """select * from (
with lim as (select quantile_cont(text_len, 0.99) as p99 from lens),
g as (select domain, text_len from lens where domain is not null),
tot as (select domain, count(*) as n_total from g group by domain),
c as (select g.domain, g.text_len from g, lim where g.text_len <= lim.p99),
rng as (select domain, min(text_len) as lo, max(text_len) as hi from c group by domain),
cnt as (
  select c.domain, cast(case when r.hi = r.lo then 25 else least(((c.text_len - r.lo) * 50) // (r.hi - r.lo), 49) end as integer) as bin, count(*) as n
  from c join rng r on c.domain = r.domain group by 1, 2
),
grid as (select r.domain, r.lo, r.hi, t.n_total, cast(b.bin as integer) as bin from rng r join tot t on r.domain = t.domain, range(0, 50) b(bin))
select grid.domain, grid.bin,
  round(grid.lo + grid.bin * (cast(grid.hi - grid.lo as double) / 50), 6) as bin_start,
  round(grid.lo + (grid.bin + 1) * (cast(grid.hi - grid.lo as double) / 50), 6) as bin_end,
  cast(coalesce(cnt.n, 0) as bigint) as n, cast(grid.n_total as bigint) as n_total
from grid left join cnt on grid.domain = cnt.domain and grid.bin = cnt.bin)""",
)
oracle(
    "distinct_groups",
    ["reviews"],
    """select distinct 'domain' as dimension, domain as value from reviews
union all select distinct 'main_category', main_category from reviews
union all select distinct 'source', source from reviews""",
)
oracle(
    "top_categories",
    ["reviews"],
    """select main_category, n, cast(row_number() over (order by n desc, main_category) as integer) as rank
from (select main_category, count(*) as n from reviews where main_category is not null group by main_category)
order by n desc, main_category limit 20""",
)
oracle(
    "groups_by_median",
    ["lens"],
    """select cast(row_number() over (order by median desc, main_category) as integer) as rank, main_category, round(median, 6) as median
from (select main_category, quantile_cont(text_len, 0.5) as median from lens where main_category is not null group by main_category)""",
)

oracle(
    "domains_by_median",
    ["lens"],
    """select cast(row_number() over (order by median desc, domain) as integer) as rank, domain, round(median, 6) as median
from (select domain, quantile_cont(text_len, 0.5) as median from lens where domain is not null group by domain)""",
)

# ---- stage-2 steps over reviews_dirty -------------------------------------
oracle("text_len", ["reviews_dirty"], f"select pos, cast(length(raw_text) as integer) as text_len, cast(length({clean_sql('raw_text')}) as integer) as clean_len from reviews_dirty")
oracle(
    "null_profile",
    ["reviews_dirty"],
    """select "column", cast(n_null as bigint) as n_null from (
  select count(*) filter (where review_index is null) as review_index, count(*) filter (where raw_text is null) as raw_text,
    count(*) filter (where source is null) as source, count(*) filter (where domain is null) as domain,
    count(*) filter (where main_category is null) as main_category, count(*) filter (where product_name is null) as product_name,
    count(*) filter (where polarity is null) as polarity, count(*) filter (where file_path is null) as file_path,
    count(*) filter (where top_folder is null) as top_folder
  from reviews_dirty
) unpivot (n_null for "column" in (review_index, raw_text, source, domain, main_category, product_name, polarity, file_path, top_folder))""",
)
_blank = f"(raw_text is not null and {clean_sql('raw_text')} = '')"
oracle(
    "missing_text_label",
    ["reviews_dirty"],
    f"""select count(*) filter (where polarity is null) as n_missing_label,
  count(*) filter (where raw_text is null) as n_null_text,
  count(*) filter (where {_blank}) as n_blank_text,
  count(*) filter (where raw_text is null or {_blank}) as n_missing_text
from reviews_dirty""",
)
oracle(
    "invalid_label_values",
    ["lab_dirty"],
    "select polarity, label_int, count(*) as n from lab_dirty where label_int is not null and label_int not in (-1, 0, 1) group by polarity, label_int",
)
oracle(
    "unmapped_labels",
    ["rd_staged"],
    "select polarity, count(*) as n from rd_staged where length(text) > 0 and label is null group by polarity",
)
oracle("parse_label", ["lab_dirty"], "select pos, polarity, label_int from lab_dirty")
oracle(
    "clean_text",
    ["reviews_dirty"],
    f"select pos, {clean_sql('raw_text')} as text, cast(length({clean_sql('raw_text')}) as integer) as text_len from reviews_dirty",
)
oracle(
    "uid_key",
    ["reviews_dirty"],
    "select pos, coalesce(file_path, 'nan') || '::' || coalesce(review_index, 'nan') as uid from reviews_dirty",
)
oracle(
    "dedup_keep_first",
    ["reviews_dirty"],
    """select uid, pos from (
  select uid, pos, row_number() over (partition by uid order by file_path, pos) as rn
  from (select *, coalesce(file_path, 'nan') || '::' || coalesce(review_index, 'nan') as uid from reviews_dirty)
) where rn = 1""",
)
oracle(
    "duplicate_profile",
    ["reviews_dirty", "rd_uid"],
    """select
  (select cast(coalesce(sum(n - 1), 0) as bigint) from (select raw_text, count(*) as n from reviews_dirty group by raw_text)) as n_dup_text,
  (select cast(coalesce(sum(n - 1), 0) as bigint) from (select review_index, count(*) as n from reviews_dirty group by review_index)) as n_dup_index,
  (select cast(coalesce(sum(n - 1), 0) as bigint) from (select uid, count(*) as n from rd_uid group by uid)) as n_dup_uid""",
)
oracle("drop_missing_label", ["reviews_dirty"], "select pos, polarity from reviews_dirty where polarity is not null")
oracle(
    "drop_empty_text",
    ["rd_staged"],
    """select count(*) as n_before, count(*) filter (where length(text) = 0) as n_removed,
  count(*) filter (where length(text) > 0) as n_after from rd_staged""",
)
oracle(
    "prep_funnel",
    ["reviews_dirty", "rd_staged"],
    """select 1 as step_no, 'loaded' as step, cast(count(*) as bigint) as n_rows from reviews_dirty
union all select 2, 'labelled', cast(count(*) filter (where polarity is not null) as bigint) from reviews_dirty
union all select 3, 'deduplicated', cast(count(*) as bigint) from rd_staged
union all select 4, 'non_empty', cast(count(*) filter (where length(text) > 0) as bigint) from rd_staged
union all select 5, 'mapped', cast(count(*) filter (where length(text) > 0 and label is not null) as bigint) from rd_staged""",
)

# ---- prepared rows, split -------------------------------------------------
oracle("label_remap", ["prepared"], "select polarity, label, count(*) as n from prepared group by polarity, label")
oracle(
    "label_names",
    ["prepared"],
    f"select label, {NAME_SQL.format(x='label')} as label_name, count(*) as n from prepared group by label",
)
cte("keyed", ["prepared"], "select *, coalesce(cast(label as varchar), 'nan') || '_' || coalesce(domain, 'nan') as raw_key from prepared")
cte(
    "strat",
    ["keyed"],
    """select k.* exclude (raw_key),
  case when c.n < 3 then coalesce(cast(k.label as varchar), 'nan') else k.raw_key end as stratify_key
from keyed k join (select raw_key, count(*) as n from keyed group by raw_key) c on k.raw_key = c.raw_key""",
)
cte("q_sizes", ["strat"], "select stratify_key, count(*) as c from strat group by stratify_key")
cte(
    "q_train",
    ["q_sizes"],
    """select *, fl + case when row_number() over (order by rem desc, stratify_key) <= n_train - sum(fl) over () then 1 else 0 end as train_q
from (select *, (c * n_train) // greatest(n, 1) as fl, (c * n_train) % greatest(n, 1) as rem
      from (select *, n - n_temp as n_train
            from (select *, sum(c) over () as n, (sum(c) over () * 2 + 9) // 10 as n_temp from q_sizes)))""",
)
cte(
    "quotas",
    ["q_train"],
    """select stratify_key, c, train_q, temp_q, valid_q, temp_q - valid_q as test_q
from (select *, fl + case when row_number() over (order by rem desc, stratify_key) <= n_valid - sum(fl) over () then 1 else 0 end as valid_q
      from (select *, (temp_q * n_valid) // greatest(n_temp, 1) as fl, (temp_q * n_valid) % greatest(n_temp, 1) as rem
            from (select stratify_key, c, n_temp, train_q, c - train_q as temp_q, n_temp - (n_temp + 1) // 2 as n_valid from q_train)))""",
)
cte(
    "splits",
    ["strat", "quotas"],
    """select s.* exclude (rk), case when s.rk <= q.test_q then 'test' when s.rk <= q.test_q + q.valid_q then 'valid' else 'train' end as split
from (select *, row_number() over (partition by stratify_key order by md5('42|' || uid), uid) as rk from strat) s
join quotas q on s.stratify_key = q.stratify_key""",
)
oracle("stratify_keys", ["strat"], "select uid, stratify_key from strat")
oracle("stratified_split", ["splits"], "select uid, split from splits")
oracle("split_sizes", ["splits"], "select split, count(*) as n from splits group by split")
oracle(
    "split_label_share",
    ["splits"],
    f"""select split, label, {NAME_SQL.format(x='label')} as label_name, n, round(n * 100.0 / sum(n) over (partition by split), 6) as pct
from (select split, label, count(*) as n from splits group by split, label)""",
)
oracle(
    "split_invariants",
    ["splits", "prepared"],
    """select 'train_valid_overlap' as "check", count(*) as n from (select uid from splits where split = 'train' intersect all select uid from splits where split = 'valid')
union all select 'train_test_overlap', count(*) from (select uid from splits where split = 'train' intersect all select uid from splits where split = 'test')
union all select 'valid_test_overlap', count(*) from (select uid from splits where split = 'valid' intersect all select uid from splits where split = 'test')
union all select 'missing_from_splits', count(*) from (select uid from prepared except all select uid from splits)
union all select 'extra_in_splits', count(*) from (select uid from splits except all select uid from prepared)""",
)
oracle("domain_filter", ["splits"], "select uid, split, domain, label from splits where domain in ('de', 'en', 'fr')")
oracle(
    "class_weights",
    ["splits"],
    """select g.label, cast(coalesce(c.n_c, 0) as bigint) as n_c,
  round(case when coalesce(c.n_c, 0) = 0 then 'inf'::double else (sum(coalesce(c.n_c, 0)) over ()) / (3.0 * c.n_c) end, 6) as weight
from (select cast(unnest(range(0, 3)) as integer) as label) g
left join (select label, count(*) as n_c from splits where split = 'train' group by label) c on g.label = c.label""",
)

# ---- tokens ---------------------------------------------------------------
cte("tok", ["prepared"], f"select *, cast({token_count_sql('text')} as integer) as token_len from prepared")
oracle("token_len", ["tok"], "select uid, token_len from tok")
oracle("token_describe", ["tok"], _describe("tok", "token_len"))
oracle("token_quantiles", ["tok"], _quantiles("tok", "token_len"))
oracle("token_stats_by_domain", ["tok"], _group_stats("tok", "domain", "token_len", [(0.9, "p90"), (0.95, "p95")]))
_CANDS = (64, 96, 128, 192, 256, 320, 384)
oracle(
    "truncation_overall",
    ["tok"],
    "\nunion all ".join(
        f"select {ml} as max_length, round(count(*) filter (where token_len > {ml}) * 100.0 / count(*), 6) as truncated_pct from tok"
        for ml in _CANDS
    ),
)
oracle(
    "truncation_curve",
    ["tok"],
    """select cast(t as integer) as max_length, cast(coalesce(sum(c) filter (v > t), 0) as bigint) as n_over,
  round(coalesce(sum(c) filter (v > t), 0) * 100.0 / sum(c), 6) as truncated_pct
from range(0, 4096) r(t), (select token_len as v, count(*) as c from tok group by token_len) group by t""",
)
cte("train_tok", ["splits"], f"select uid, domain, cast({token_count_sql('text')} as integer) as token_len from splits where split = 'train'")
cte("train_both", ["train_tok"], "select * from train_tok union all select uid, '(all)', token_len from train_tok")
oracle("train_token_stats", ["train_both"], _group_stats("train_both", "domain", "token_len", [(0.9, "p90"), (0.95, "p95"), (0.99, "p99")]))
oracle(
    "train_truncation",
    ["train_both"],
    "select domain, count(*) as count, "
    + ", ".join(f"round(count(*) filter (where token_len > {ml}) * 100.0 / count(*), 6) as trunc_{ml}" for ml in _CANDS)
    + " from train_both where domain is not null group by domain",
)
oracle(
    "truncation_by_domain",
    ["tok"],
    "select domain, count(*) as count, "
    + ", ".join(f"round(count(*) filter (where token_len > {ml}) * 100.0 / count(*), 6) as trunc_{ml}" for ml in _CANDS)
    + " from tok where domain is not null group by domain",
)
_REC = _CANDS + (512, 768, 1024, 1536, 2048, 3072, 4096)
oracle(
    "recommend_max_length",
    ["tok"],
    """select cast(coalesce(min(ml) filter (where over_n * 100 <= 5 * n), max(ml)) as integer) as recommended_max_length,
  round(arg_min(over_n * 100.0 / n, case when over_n * 100 <= 5 * n then ml else 100000 + ml end), 6) as truncated_pct,
  max(n) as n
from (select c.ml, (select count(*) from tok) as n, (select count(*) from tok where token_len > c.ml) as over_n
      from (select unnest(["""
    + ", ".join(str(x) for x in _REC)
    + """]) as ml) c)""",
)
ORACLES["train_recommend_max_length"] = with_ctes(ORACLES["recommend_max_length"][ORACLES["recommend_max_length"].index("select cast(coalesce(min(ml)") :].replace("from tok", "from train_tok"), ["train_tok"])
oracle(
    "truncate_tokens",
    ["prepared"],
    f"""select uid, cast(len(t) as integer) as kept_len, array_to_string(t, ' ') as truncated
from (select uid, list_concat(['[CLS]'], list_slice({tokens_sql('text')}, 1, 190), ['[SEP]']) as t from prepared)""",
)
oracle(
    "padding_share",
    ["tok"],
    """select count(*) as n, 192 as max_length, cast(sum(least(token_len, 192)) as bigint) as real_tokens,
  cast(count(*) * 192 - sum(least(token_len, 192)) as bigint) as pad_tokens,
  round((count(*) * 192 - sum(least(token_len, 192))) * 100.0 / (count(*) * 192), 6) as padding_pct
from tok""",
)
oracle(
    "vocab_top",
    ["prepared"],
    f"""select token, n, cast(row_number() over (order by n desc, token) as integer) as rank
from (select token, count(*) as n from (select unnest({tokens_sql('text')}) as token from prepared) group by token)
order by n desc, token limit 50""",
)

# Continuation pieces are single characters, so the greedy match is the longest known
# prefix followed by one piece per character; an unknown character makes the word [UNK].
cte("wp_tokens", ["prepared"], f"select uid, unnest({tokens_sql('text')}) as token from prepared")
cte("wp_counts", ["wp_tokens"], "select token, count(*) as n from wp_tokens group by token")
cte("wp_words", ["wp_counts"], "select token as piece from wp_counts order by n desc, token limit 8000")
cte(
    "wp_chars",
    ["wp_counts"],
    """select ch as piece from (select unnest(regexp_extract_all(token, '(?s).')) as ch, n from wp_counts)
group by ch order by sum(n) desc, ch limit 2000""",
)
cte("wp_places", ["wp_counts"], "select token, unnest(range(1, length(token) + 1)) as i from wp_counts")
cte(
    "wp_pieces",
    ["wp_places", "wp_words", "wp_chars"],
    """select token, max(case when left(token, i) in (select piece from wp_words union select piece from wp_chars) then i end) as prefix,
  max(case when substr(token, i, 1) not in (select piece from wp_chars) then i else 0 end) as unknown
from wp_places group by token""",
)
oracle(
    "wordpiece_len",
    ["wp_tokens", "wp_pieces"],
    """select uid, cast(2 + sum(case when length(token) > 100 or prefix is null or unknown > prefix then 1
  else 1 + length(token) - prefix end) as integer) as wp_len
from wp_tokens join wp_pieces using (token) group by uid""",
)

# ---- metrics over fixture predictions ------------------------------------
cte("cc", ["predictions_long"], "select run, label, pred, count(*) as n from predictions_long group by run, label, pred")
cte(
    "pc",
    ["cc"],
    """select g.run, g.cls, coalesce(t.tp, 0) as tp, coalesce(t.support, 0) as support, coalesce(p.predicted, 0) as predicted
from (select distinct run, cast(unnest(range(0, 3)) as integer) as cls from cc) g
left join (select run, label as cls, cast(sum(n) as bigint) as support, cast(sum(case when label = pred then n else 0 end) as bigint) as tp
           from cc group by run, label) t on g.run = t.run and g.cls = t.cls
left join (select run, pred as cls, cast(sum(n) as bigint) as predicted from cc group by run, pred) p on g.run = p.run and g.cls = p.cls""",
)
cte(
    "pcm",
    ["pc"],
    """select *, case when predicted > 0 then tp / predicted else 0.0 end as precision,
  case when support > 0 then tp / support else 0.0 end as recall,
  case when tp > 0 then 2.0::double * tp / (2 * tp + (predicted - tp) + (support - tp)) else 0.0 end as f1,
  (support > 0 or predicted > 0) as present
from pc""",
)
cte(
    "f1m",
    ["pcm"],
    "select run, round(avg(f1), 6) as f1_macro from pcm where present group by run",
)
cte(
    "accm",
    ["predictions_long"],
    "select run, count(*) as n, round(avg(case when label = pred then 1.0 else 0.0 end), 6) as accuracy from predictions_long group by run",
)
oracle("accuracy", ["accm"], "select run, n, accuracy from accm")
oracle("f1_macro", ["f1m"], "select run, f1_macro from f1m")
oracle(
    "classification_report",
    ["pcm"],
    f"""select run, {NAME_SQL.format(x='cls')} as "row", round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from pcm
union all select run, 'accuracy', null, null, round(sum(tp) / sum(support), 6), cast(sum(support) as bigint) from pcm group by run
union all select run, 'macro avg', round(avg(precision) filter (where present), 6), round(avg(recall) filter (where present), 6),
  round(avg(f1) filter (where present), 6), cast(sum(support) as bigint) from pcm group by run
union all select run, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from pcm group by run""",
)
oracle(
    "confusion_matrix",
    ["cc"],
    f"""select g.run, g.cls as true_label, {NAME_SQL.format(x='g.cls')} as true_name,
  cast(coalesce(sum(cc.n) filter (where cc.pred = 0), 0) as bigint) as pred_0,
  cast(coalesce(sum(cc.n) filter (where cc.pred = 1), 0) as bigint) as pred_1,
  cast(coalesce(sum(cc.n) filter (where cc.pred = 2), 0) as bigint) as pred_2
from (select distinct run, cast(unnest(range(0, 3)) as integer) as cls from cc) g
left join cc on cc.run = g.run and cc.label = g.cls
group by g.run, g.cls""",
)
oracle(
    "argmax_prediction",
    ["predictions"],
    "select doc_id, cast(list_position([s0, s1, s2], list_max([s0, s1, s2])) - 1 as integer) as pred from predictions",
)
oracle(
    "weighted_log_loss",
    ["predictions"],
    """select round(sum(w * loss) / sum(w), 6) as weighted_log_loss, round(avg(loss), 6) as log_loss, count(*) as n
from (
  select p.label, cw.w,
    list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[p.label + 1] as loss
  from (select label, [s0, s1, s2] as l from predictions) p
  left join (select label, (sum(n_c) over ()) / (3.0 * n_c) as w from (select label, count(*) as n_c from predictions group by label)) cw
    on p.label = cw.label
)""",
)
oracle("select_best", ["f1m"], "select run as best, f1_macro from f1m order by f1_macro desc, run limit 1")
oracle(
    "compare_runs",
    ["accm", "f1m"],
    """select metric, round(a, 6) as run_a, round(b, 6) as run_b, round(b - a, 6) as diff,
  round(case when a = 0 then null else b / a end, 6) as ratio,
  round((1.0 - case when a = 0 then null else b / a end) * 100.0, 6) as pct_reduction,
  round(case when b = 0 then null else a / b end, 6) as factor
from (
  select 'test_accuracy' as metric, max(accuracy) filter (where run = 'a') as a, max(accuracy) filter (where run = 'b') as b from accm
  union all select 'test_f1_macro', max(f1_macro) filter (where run = 'a'), max(f1_macro) filter (where run = 'b') from f1m
  union all select 'n_test', cast(max(n) filter (where run = 'a') as double), cast(max(n) filter (where run = 'b') as double) from accm
)""",
)

# ---- ingest over fixture payload documents --------------------------------
cte("payload_kind", ["reviews"], "select *, cast(substr(main_category, 4) as integer) % 4 as kind_no from reviews")
oracle(
    "ingest_payload_rows",
    ["payload_kind"],
    """select file_path, cast(row_number() over (partition by file_path order by pos) - 1 as integer) as _pos, review_index, raw_text
from payload_kind where kind_no <> 3""",
)
oracle(
    "ingest_payload_status",
    ["payload_kind"],
    """select file_path, case kind_no when 1 then 'object' when 3 then 'corrupt' else 'array' end as kind,
  cast(case when kind_no = 3 then 0 else count(*) end as bigint) as n_rows,
  cast(case when kind_no = 2 then 1 else 0 end as bigint) as n_skipped
from payload_kind group by file_path, kind_no""",
)
# documents whose closing bracket is missing give one row without an element, the scalar of the others' lists is one
oracle(
    "ingest_ranged_rows",
    ["payload_kind"],
    """select file_path, case kind_no when 1 then 'object' else 'array' end as kind,
  cast(row_number() over (partition by file_path order by pos) - 1 as integer) as _pos, true as _is_object, review_index, raw_text
from payload_kind where kind_no <> 3
union all select file_path, 'array', cast(count(*) as integer), false, null, null from payload_kind where kind_no = 2 group by file_path
union all select distinct file_path, 'corrupt', cast(null as integer), false, null, null from payload_kind where kind_no = 3""",
)
oracle(
    "ingest_provenance",
    ["payload_kind"],
    "select file_path, top_folder, count(*) as n_rows from payload_kind where kind_no <> 3 group by file_path, top_folder",
)
oracle(
    "ingest_contract_projection",
    ["payload_kind"],
    """select review_index, raw_text, source, domain, main_category, product_name, polarity, file_path, top_folder,
  cast(row_number() over (partition by file_path order by pos) - 1 as integer) as pos,
  cast(polarity as integer) as label_int
from payload_kind where kind_no <> 3""",
)
oracle(
    "union_by_name_sources",
    ["reviews"],
    """select review_index, case when top_folder = 'shop' then source end as source, domain,
  case when top_folder = 'sns' then main_category end as main_category, top_folder, pos
from reviews where top_folder in ('shop', 'sns')""",
)

# ---- tables written, read back and measured --------------------------------
oracle("csv_roundtrip", ["reviews_dirty"], "select pos, review_index, raw_text, domain, polarity from reviews_dirty")
oracle(
    "csv_quarantine",
    ["reviews"],
    """select case when bad then null else pos end as pos, case when bad then null else domain end as domain,
  case when bad then null else main_category end as main_category,
  case when pos % 7 = 0 then pos || ',' || domain
       when pos % 11 = 0 then pos || ',' || domain || ',' || main_category || ',more'
       when pos % 13 = 0 then 'no' || pos || ',' || domain || ',' || main_category end as record
from (select *, pos % 7 = 0 or pos % 11 = 0 or pos % 13 = 0 as bad from reviews)""",
)
oracle("label_map_roundtrip", ["prepared"], f"select label, {NAME_SQL.format(x='label')} as label_name, count(*) as n from prepared group by label")
oracle(
    "dir_size",
    ["reviews_dirty"],
    f"""select cast(sum(strlen({clean_sql('raw_text')}) + 1) as bigint) as n_bytes,
  round(sum(strlen({clean_sql('raw_text')}) + 1) / 1048576.0, 6) as size_mb from reviews_dirty""",
)

# ---- training: the test split, its sizes and the parameters of the two feature spaces
oracle("train_predict", ["splits"], "select uid, label, true as predicted from splits where split = 'test'")
oracle(
    "train_compare",
    ["splits"],
    """select run_tag, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'valid') as n_valid, count(*) filter (split = 'test') as n_test,
  cast(3 * features + 3 as bigint) as total_params, true as scored
from splits, (values ('wide', 16384), ('compact', 1024)) v(run_tag, features) group by run_tag, features""",
)
