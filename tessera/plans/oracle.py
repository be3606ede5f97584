"""DuckDB oracle SQL for the registered queries (same column names and rounding).

Written independently of the Spark code path: plain window functions,
``quantile_cont`` and cross joins are fine here because the oracle only runs
on the small correctness scale.
"""

from __future__ import annotations

from itertools import combinations, permutations

from tessera.plans import catalog as C


def _h(expr: str, seed=C.SEED) -> str:
    return f"md5(cast({expr} as varchar) || '{seed}')"


def _half(expr: str, a="first", b="second") -> str:
    return f"case when substr({_h(expr)}, 1, 8) < '80000000' then '{a}' else '{b}' end"


LF = ("select l_orderkey, l_linenumber, l_returnflag, "
      + ", ".join(f"nullif({c}, 0) as {c}" for c in C.L) + " from lineitem")
EVF = "select event_id, value, cast(json_extract(props, '$.k') as double) as k from events"
EVH = f"select *, {_half('event_id')} as split from ({EVF})"


def _union(parts):
    return "\nunion all\n".join(parts)


def zero_as_missing_profile():
    return _union([f"select '{c}' as column_name, count(*) as n_rows, count(*) filter (where {c} is null) as missing, "
                   f"round(100.0 * count(*) filter (where {c} is null) / count(*), 2) as missing_pct from ({LF})"
                   for c in C.L])


def required_dropna():
    cond = " and ".join(f"{c} is not null" for c in C.L)
    return f"select l_orderkey, l_linenumber, {', '.join(C.L)} from ({LF}) where {cond}"


def _bounds_cte(src: str, cols) -> str:
    sel = ", ".join(f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in cols)
    return f"select {sel} from ({src})"


def iqr_bounds():
    parts = []
    for c in sorted(C.L):
        parts.append(f"select '{c}' as column_name, round(q1_{c}, 6) as q1, round(q3_{c}, 6) as q3, "
                     f"round(q3_{c} - q1_{c}, 6) as iqr, round(q1_{c} - 1.5 * (q3_{c} - q1_{c}), 6) as lower_bound, "
                     f"round(q3_{c} + 1.5 * (q3_{c} - q1_{c}), 6) as upper_bound from b")
    return f"with b as ({_bounds_cte(LF, C.L)})\n" + _union(parts)


def _outside(c):
    return (f"coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) or {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false)")


def outlier_filter():
    anyout = " or ".join(_outside(c) for c in C.L)
    return (f"with b as ({_bounds_cte(LF, C.L)})\n"
            f"select l_orderkey, l_linenumber, {', '.join(C.L)} from ({LF}) t, b where not ({anyout})")


def outlier_filter_split():
    anyout = " or ".join(_outside(c) for c in C.EV)
    train = "select * from e where split = 'first'"
    return (f"with e as ({EVH}), b as ({_bounds_cte(train, C.EV)})\n"
            f"select event_id, value, k from e, b where split = 'second' and not ({anyout})")


def outlier_counts():
    anyout = " or ".join(_outside(c) for c in C.EV)
    parts = [f"select '{c}' as column_name, count(*) filter (where {_outside(c)}) as n_outliers from e, b"
             for c in sorted(C.EV)]
    parts.append(f"select '__any__' as column_name, count(*) filter (where {anyout}) as n_outliers from e, b")
    return f"with e as ({EVF}), b as ({_bounds_cte('select * from e', C.EV)})\n" + _union(parts)


def corr_matrix():
    parts = [f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as corr from ({LF})"
             for a, b in permutations(C.L_SORTED, 2)]
    parts += [f"select '{c}' as column_a, '{c}' as column_b, case when min({c}) < max({c}) then 1.0 end as corr "
              f"from ({LF})" for c in C.L_SORTED]
    return _union(parts)


def corr_with_label():
    src = f"select *, cast(l_returnflag = 'R' as integer) as label from ({LF})"
    return _union([f"select '{c}' as column_name, round(corr({c}, label), 6) as corr from ({src})"
                   for c in C.L_SORTED])


def complete_pairs():
    return _union([f"select '{a}' as column_a, '{b}' as column_b, "
                   f"count(*) filter (where {a} is not null and {b} is not null) as n_complete from ({LF})"
                   for a, b in combinations(C.L_SORTED, 2)])


def value_counts():
    return "select o_orderpriority as value, count(*) as count from orders group by 1"


_STRAT = f"""
with c as (select o_orderstatus, count(*) as n from orders group by 1),
t as (select sum(n) as n_all, cast(ceil(0.2 * sum(n)) as bigint) as n_test from c),
a as (select c.o_orderstatus, c.n, t.n_all - t.n_test as n_train,
             ((t.n_all - t.n_test) * c.n) // t.n_all as fl, ((t.n_all - t.n_test) * c.n) % t.n_all as rem
      from c, t),
b as (select *, n_train - sum(fl) over () as need,
             row_number() over (order by rem desc, o_orderstatus) as rk from a),
q as (select o_orderstatus, n - (fl + case when rk <= need then 1 else 0 end) as n_test_c from b),
r as (select o_orderkey, o_orderstatus,
             row_number() over (partition by o_orderstatus order by {_h('o_orderkey')}, o_orderkey) as rn
      from orders),
s as (select r.o_orderkey, r.o_orderstatus,
             case when r.rn <= q.n_test_c then 'test' else 'train' end as split
      from r join q using (o_orderstatus))
"""


def stratified_split():
    return _STRAT + "select o_orderkey, o_orderstatus, split from s"


def split_proportions():
    return _STRAT + ("select split, count(*) as rows, round(count(*) / sum(count(*)) over (), 4) as share "
                     "from s group by split")


def hash_split():
    return f"select event_id, split from ({EVH})"


def minmax_fit():
    return _union([f"select '{c}' as column_name, min({c}) as min, max({c}) as max from ({EVH}) where split = 'first'"
                   for c in C.EV])


def minmax_transform():
    st = ", ".join(f"min({c}) as mn_{c}, max({c}) as mx_{c}" for c in C.EV)
    cols = ", ".join(f"round(({c} - mn_{c}) / (case when mx_{c} - mn_{c} = 0 then 1.0 else mx_{c} - mn_{c} end), 6) as {c}"
                     for c in C.EV)
    return (f"with e as ({EVH}), st as (select {st} from e where split = 'first')\n"
            f"select event_id, {cols} from e, st where split = 'second'")


def class_weights():
    return ("with c as (select quality as label, count(*) as n from labels group by 1)\n"
            "select label, n, round(case when label = 1 then 1.5 else 1.0 end * sum(n) over () / "
            "(count(*) over () * n), 4) as weight from c")


_FILL = f"""
with t as ({LF}),
m as (select l_returnflag, avg(l_discount) as m_d, avg(l_tax) as m_t from t group by 1),
f as (select t.l_orderkey, t.l_linenumber, t.l_returnflag,
             coalesce(t.l_discount, m.m_d) as l_discount, coalesce(t.l_tax, m.m_t) as l_tax,
             t.l_discount is null as l_discount_imputed, t.l_tax is null as l_tax_imputed
      from t left join m using (l_returnflag))
"""


def conditional_fill():
    return _FILL + ("select l_orderkey, l_linenumber, l_returnflag, round(l_discount, 6) as l_discount, "
                    "round(l_tax, 6) as l_tax, l_discount_imputed, l_tax_imputed from f")


def imputed_flags():
    return _FILL + _union([f"select '{c}' as column_name, count(*) filter (where {c}_imputed) as n_imputed, "
                           f"bool_or({c}_imputed) as any_imputed from f" for c in ("l_discount", "l_tax")])


def _dist_sql(metric: str, a: str = "a.v", b: str = "b.v") -> str:
    rng = "range(1, len(a.v) + 1)".replace("a.v", a)
    if metric == "chebyshev":
        return f"list_max(list_transform({rng}, lambda i: abs({a}[i] - {b}[i])))"
    if metric == "manhattan":
        return f"list_sum(list_transform({rng}, lambda i: abs({a}[i] - {b}[i])))"
    if metric == "euclidean":
        return f"sqrt(list_sum(list_transform({rng}, lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"
    if metric == "cosine":
        dot = f"list_sum(list_transform({rng}, lambda i: {a}[i] * {b}[i]))"
        na = f"sqrt(list_sum(list_transform({rng}, lambda i: {a}[i] * {a}[i])))"
        nb = f"sqrt(list_sum(list_transform({rng}, lambda i: {b}[i] * {b}[i])))"
        return f"1 - {dot} / ({na} * {nb})"
    if metric.startswith("minkowski"):
        p = metric.split()[1]
        return f"pow(list_sum(list_transform({rng}, lambda i: pow(abs({a}[i] - {b}[i]), {p}))), 1.0 / {p})"
    raise ValueError(metric)


_EMB = ("select vec_id as key, cast(embedding as double[]) as v, cast(label >= 5 as integer) as y "
        "from embeddings")


def knn_chebyshev():
    d = _dist_sql("chebyshev")
    return (f"with e as ({_EMB}), p as (select a.key as q_key, b.key as n_key, {d} as distance "
            f"from e a, e b), r as (select *, row_number() over (partition by q_key order by distance, n_key) as rank "
            f"from p)\nselect q_key, rank, n_key, round(distance, 6) as distance from r where rank <= 22")


def knn_classify():
    d = _dist_sql("chebyshev")
    return (f"with e as ({_EMB}), p as (select a.key as q_key, b.key as n_key, b.y, {d} as distance "
            f"from e a, e b), r as (select *, row_number() over (partition by q_key order by distance, n_key) as rank "
            f"from p)\nselect q_key as key, round(avg(y), 6) as p_pos, cast(avg(y) > 0.5 as integer) as pred "
            f"from r where rank <= 22 group by q_key")


def knn_metric_grid():
    ks = ", ".join(str(k) for k in C.KNN_GRID_K)
    kmax = max(C.KNN_GRID_K)
    parts = []
    for m in C.KNN_GRID_METRICS:
        m = m if isinstance(m, str) else f"{m[0]} {m[1]:g}"
        d = _dist_sql(m)
        parts.append(f"select '{m}' as metric, a.key as q_key, a.y as y_true, b.key as n_key, b.y, {d} as distance "
                     f"from tr b, va a")
    return f"""
with e as (select *, {_half('key')} as split from ({_EMB})),
tr as (select * from e where split = 'first'), va as (select * from e where split = 'second'),
p as ({_union(parts)}),
r as (select *, row_number() over (partition by metric, q_key order by distance, n_key) as rank from p),
c as (select metric, q_key, y_true, rank,
             sum(y) over w as sy,
             sum(case when distance = 0 then 1.0 else 0.0 end) over w as z,
             sum(case when distance = 0 then y else 0.0 end) over w as zy,
             sum(case when distance > 0 then 1.0 / distance else 0.0 end) over w as sw,
             sum(case when distance > 0 then y / distance else 0.0 end) over w as swy
      from r where rank <= {kmax}
      window w as (partition by metric, q_key order by rank rows between unbounded preceding and current row)),
v as (select metric, 'uniform' as weights, rank as k, sy / rank as p, y_true from c where rank in ({ks})
      union all
      select metric, 'distance' as weights, rank as k,
             case when z > 0 then zy / z else swy / sw end as p, y_true from c where rank in ({ks})),
acc as (select metric, weights, k, avg(case when cast(p > 0.5 as integer) = y_true then 1.0 else 0.0 end) as accuracy
        from v group by 1, 2, 3)
select metric, weights, k, round(accuracy, 6) as accuracy from acc
order by accuracy desc, k, metric, weights limit 5"""


def fcm_memberships():
    c0, c1 = C.FCM_CENTERS
    d0 = f"sqrt((value - {c0[0]}) * (value - {c0[0]}) + (k - {c0[1]}) * (k - {c0[1]}))"
    d1 = f"sqrt((value - {c1[0]}) * (value - {c1[0]}) + (k - {c1[1]}) * (k - {c1[1]}))"
    return (f"with e as ({EVF}), d as (select event_id, {d0} as d0, {d1} as d1 from e)\n"
            "select event_id, "
            "round(case when d0 = 0 or d1 = 0 then (case when d0 = 0 then 1.0 else 0.0 end) "
            "else 1.0 / (pow(d0 / d0, 2) + pow(d0 / d1, 2)) end, 6) as u0, "
            "round(case when d0 = 0 or d1 = 0 then (case when d1 = 0 then 1.0 else 0.0 end) "
            "else 1.0 / (pow(d1 / d0, 2) + pow(d1 / d1, 2)) end, 6) as u1 from d")


def fcm_centers():
    eps = "2.220446049250313e-16"
    init = []
    for i in range(2):
        init.append(f"cast(('0x' || substr(md5(cast(event_id as varchar) || '|{C.SEED}|{i}'), 1, 8)) as bigint) "
                    f"/ 4294967296.0")
    ctes = [f"e0 as ({EVF})",
            "st as (select min(value) as mnv, max(value) as mxv, min(k) as mnk, max(k) as mxk from e0)",
            "x as (select event_id, (value - mnv) / (case when mxv = mnv then 1.0 else mxv - mnv end) as v, "
            "(k - mnk) / (case when mxk = mnk then 1.0 else mxk - mnk end) as k from e0, st)",
            f"r0 as (select event_id, v, k, {init[0]} as a, {init[1]} as b from x)",
            f"u0 as (select v, k, greatest(a / (a + b), {eps}) as u0, greatest(b / (a + b), {eps}) as u1 from r0)"]

    def centres(src, n):
        return (f"c{n} as (select sum(pow(u0, 2) * v) / sum(pow(u0, 2)) as c0v, sum(pow(u0, 2) * k) / sum(pow(u0, 2)) as c0k, "
                f"sum(pow(u1, 2) * v) / sum(pow(u1, 2)) as c1v, sum(pow(u1, 2) * k) / sum(pow(u1, 2)) as c1k from {src})")

    def members(n):
        d0 = f"greatest(sqrt((v - c0v) * (v - c0v) + (k - c0k) * (k - c0k)), {eps})"
        d1 = f"greatest(sqrt((v - c1v) * (v - c1v) + (k - c1k) * (k - c1k)), {eps})"
        return (f"u{n} as (select v, k, pow({d0}, -2.0) / (pow({d0}, -2.0) + pow({d1}, -2.0)) as u0, "
                f"pow({d1}, -2.0) / (pow({d0}, -2.0) + pow({d1}, -2.0)) as u1 from x, c{n})")

    iters = C.FCM_ITER - 1
    ctes.append(centres("u0", 1))
    for n in range(1, iters):
        ctes.append(members(n))
        ctes.append(centres(f"u{n}", n + 1))
    last = f"c{iters}"
    first = "(c0v < c1v or (c0v = c1v and c0k <= c1k))"
    return ("with " + ",\n".join(ctes) + "\n"
            f"select 0 as cluster, round(case when {first} then c0v else c1v end, 6) as value, "
            f"round(case when {first} then c0k else c1k end, 6) as k from {last}\n"
            "union all\n"
            f"select 1 as cluster, round(case when {first} then c1v else c0v end, 6) as value, "
            f"round(case when {first} then c1k else c0k end, 6) as k from {last}")


def svm_score_minmax():
    s = f"value * {C.SVM_W['value']} + k * {C.SVM_W['k']} + {C.SVM_B}"
    return (f"with e as (select event_id, {s} as s from ({EVF})), r as (select min(s) as mn, max(s) as mx from e)\n"
            "select event_id, round((s - mn) / ((mx - mn) + 1e-8), 6) as score from e, r")


DOCS = ("select d.doc_id, l.quality as label, cast(d.n_chars > {t} as integer) as m_len, "
        "cast(d.lang = 'en' as integer) as m_lang, cast(d.n_chars < {t5} as integer) as m_short "
        "from documents d join labels l using (doc_id)").format(t=C.LEN_T, t5=5 * C.LEN_T)


def confusion_matrix():
    return f"select label as actual, m_len as predicted, count(*) as count from ({DOCS}) group by 1, 2"


def _bm(src: str, pred: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" group by {group}" if group else ""
    return (f"select {g}tp, fp, fn, tn, "
            "round(case when tp + fp + fn + tn = 0 then 0.0 else (tp + tn) / (tp + fp + fn + tn) end, 6) as accuracy, "
            "round(case when tp + fp = 0 then 0.0 else tp / (tp + fp) end, 6) as precision, "
            "round(case when tp + fn = 0 then 0.0 else tp / (tp + fn) end, 6) as recall, "
            "round(case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1 "
            f"from (select {g}count(*) filter (where label = 1 and {pred} = 1) as tp, "
            f"count(*) filter (where label <> 1 and {pred} = 1) as fp, "
            f"count(*) filter (where label = 1 and {pred} <> 1) as fn, "
            f"count(*) filter (where label <> 1 and {pred} <> 1) as tn from ({src}){gb})")


def binary_metrics():
    return _bm(DOCS, "m_len")


def classification_report():
    return f"""
with d as ({DOCS}),
cls as (select label as c from d union select m_len from d),
per as (select c, count(*) filter (where label = c and m_len = c) as tp,
               count(*) filter (where m_len = c) as pp, count(*) filter (where label = c) as support
        from cls, d group by c),
m as (select cast(c as varchar) as row_name,
             case when pp = 0 then 0.0 else tp / pp end as precision,
             case when support = 0 then 0.0 else tp / support end as recall,
             case when pp + support = 0 then 0.0 else 2 * tp / (pp + support) end as f1,
             support, tp from per)
select row_name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
       cast(support as bigint) as support from m
union all
select 'accuracy', null, null, round(sum(tp) / sum(support), 6), cast(sum(support) as bigint) from m
union all
select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from m
union all
select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from m"""


def log_loss():
    p = f"least(greatest(n_chars / (n_chars + {float(C.LEN_T)}), 1e-7), 1 - 1e-7)"
    return (f"select count(*) as n, round(avg(-(quality * ln({p}) + (1 - quality) * ln(1 - {p}))), 6) as log_loss "
            "from documents d join labels l using (doc_id)")


def best_model_diff():
    long = _union([f"select doc_id, label, '{m}' as model, {expr} as pred from ({DOCS})"
                   for m, expr in [("m_len", "m_len"), ("m_lang", "m_lang"), ("m_short", "m_short"),
                                   ("meta", "cast(m_len + m_lang + m_short >= 2 as integer)")]])
    ms = ["accuracy", "precision", "recall", "f1"]
    parts = [f"select b.model as best_model, '{m}' as metric, b.{m} as best_value, mm.{m} as meta_value, "
             f"round(mm.{m} - b.{m}, 6) as diff from b, mm" for m in ms]
    return (f"with mt as ({_bm(long, 'pred', 'model')}),\n"
            "b as (select * from mt where model <> 'meta' order by accuracy desc, model limit 1),\n"
            "mm as (select * from mt where model = 'meta')\n" + _union(parts))


_REG = f"""
with li as (select l_orderkey, l_linenumber, l_returnflag, l_quantity,
                   {_half("cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar)", 'train', 'val')} as split
            from lineitem),
m as (select l_returnflag, avg(l_quantity) as pred from li where split = 'train' group by 1),
j as (select li.*, m.pred from li join m using (l_returnflag)),
g as (select split, count(*) as n, avg((l_quantity - pred) * (l_quantity - pred)) as mse,
             sum((l_quantity - pred) * (l_quantity - pred)) as sse, var_pop(l_quantity) as vp
      from j group by split),
r as (select split, n, mse, case when vp = 0 then null else 1 - sse / (vp * n) end as r2 from g)
"""


def regression_metrics():
    return _REG + "select split, n, round(mse, 6) as mse, round(r2, 6) as r2 from r"


def overfit_bucket():
    return _REG + """, w as (select max(r2) filter (where split = 'train') as tr, max(r2) filter (where split = 'val') as va from r)
select round(tr, 6) as r2_train, round(va, 6) as r2_val, round(tr - va, 6) as gap,
       case when tr - va > 0.3 then 'significant' when tr - va > 0.1 then 'moderate' else 'minimal' end as bucket
from w"""


def domain_violations():
    return _union([f"select '{c}' as column_name, {float(lo)} as lo, {float(hi)} as hi, "
                   f"count(*) filter (where {c} < {lo}) as n_below, count(*) filter (where {c} > {hi}) as n_above "
                   f"from ({LF})" for c, (lo, hi) in C.DOMAINS.items()])


def parse_inputs():
    def parsed(x):
        return f"try_cast(nullif(trim({x}), '') as double)"

    def bad(x):
        return f"(nullif(trim({x}), '') is not null and try_cast(trim({x}) as double) is null)"
    fields = ["k_text", "value_text", "type_text"]
    nrej = " + ".join(f"cast({bad(f)} as integer)" for f in fields)
    return ("with e as (select event_id, regexp_extract(props, ':(.*)}', 1) as k_text, "
            "cast(value as varchar) as value_text, event_type as type_text from events)\n"
            f"select event_id, nullif({parsed('k_text')}, 0.0) as k, {parsed('value_text')} as value, "
            f"{nrej} as n_rejected, ({nrej}) = 0 as ok from e")


def scored_export():
    p = "o_totalprice / (o_totalprice + 150000.0)"
    return ("select o_orderkey, round(p, 6) as predicted_probability, cast(p > 0.5 as integer) as predicted_outcome, "
            "case when p > 0.5 then 'High' else 'Low' end as outcome_text, "
            "cast(o_orderpriority = '1-URGENT' as integer) = cast(p > 0.5 as integer) as correct "
            f"from (select *, {p} as p from orders)")


def weighted_union():
    return (f"select event_id, split, 1.0 as w from ({EVH}) where split = 'first'\nunion all\n"
            f"select event_id, split, 5.0 as w from ({EVH}) where split = 'second'")


ORACLE = {name: fn() for name, fn in [
    ("zero_as_missing_profile", zero_as_missing_profile),
    ("required_dropna", required_dropna),
    ("iqr_bounds", iqr_bounds),
    ("outlier_filter", outlier_filter),
    ("outlier_filter_split", outlier_filter_split),
    ("outlier_counts", outlier_counts),
    ("corr_matrix", corr_matrix),
    ("corr_with_label", corr_with_label),
    ("complete_pairs", complete_pairs),
    ("value_counts", value_counts),
    ("stratified_split", stratified_split),
    ("split_proportions", split_proportions),
    ("hash_split", hash_split),
    ("minmax_fit", minmax_fit),
    ("minmax_transform", minmax_transform),
    ("class_weights", class_weights),
    ("conditional_fill", conditional_fill),
    ("imputed_flags", imputed_flags),
    ("knn_chebyshev", knn_chebyshev),
    ("knn_classify", knn_classify),
    ("knn_metric_grid", knn_metric_grid),
    ("fcm_memberships", fcm_memberships),
    ("fcm_centers", fcm_centers),
    ("svm_score_minmax", svm_score_minmax),
    ("confusion_matrix", confusion_matrix),
    ("binary_metrics", binary_metrics),
    ("classification_report", classification_report),
    ("log_loss", log_loss),
    ("best_model_diff", best_model_diff),
    ("regression_metrics", regression_metrics),
    ("overfit_bucket", overfit_bucket),
    ("domain_violations", domain_violations),
    ("parse_inputs", parse_inputs),
    ("scored_export", scored_export),
    ("weighted_union", weighted_union),
]}


def fold_assignment():
    return (f"select event_id, cast((('0x' || substr({_h('event_id')}, 1, 8))::bigint) % 5 as integer) as fold "
            f"from ({EVF})")


def predefined_split():
    return f"select event_id, case when split = 'first' then 'train' else 'val' end as role from ({EVH})"


def outlier_flags():
    return (f"with e as ({EVF}), b as ({_bounds_cte('select * from e', C.EV)})\n"
            f"select event_id, {_outside('value')} as out_value, {_outside('k')} as out_k from e, b")


def f1_stabilised():
    return (f"with m as ({_bm(DOCS, 'm_len')}), r as (select "
            "case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as p, "
            "case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as r from "
            f"(select count(*) filter (where label = 1 and m_len = 1) as tp, "
            f"count(*) filter (where label <> 1 and m_len = 1) as fp, "
            f"count(*) filter (where label = 1 and m_len <> 1) as fn from ({DOCS})))\n"
            "select round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r + 1e-7), 6) as f1_stable from r")


def train_val_comparison():
    src = f"select *, {_half('doc_id', 'train', 'val')} as split from ({DOCS})"
    long = _union([f"select doc_id, label, split, '{m}' as model, {m} as pred from ({src})"
                   for m in ("m_len", "m_lang", "m_short")])
    return _bm(long, "pred", "model, split")


def head_rows():
    return "select o_orderkey, o_totalprice from orders order by o_orderkey limit 5"


ORACLE.update({
    "fold_assignment": fold_assignment(),
    "predefined_split": predefined_split(),
    "outlier_flags": outlier_flags(),
    "f1_stabilised": f1_stabilised(),
    "train_val_comparison": train_val_comparison(),
    "head_rows": head_rows(),
})


def quality_profile():
    anyout = " or ".join(_outside(c) for c in C.L)
    parts = []
    for c in C.L:
        parts.append(
            f"select '{c}' as column_name, count(*) filter (where kept) as n_rows, "
            f"count(*) filter (where kept and {c} is null) as missing, "
            f"round(case when count(*) filter (where kept) = 0 then 0.0 else "
            f"100.0 * count(*) filter (where kept and {c} is null) / count(*) filter (where kept) end, 2) as missing_pct, "
            f"count(*) filter (where {_outside(c)}) as n_outliers from k")
    return (f"with t as ({LF}), b as ({_bounds_cte(LF, C.L)}), "
            f"k as (select t.*, b.*, not ({anyout}) as kept from t, b)\n" + _union(parts))


ORACLE["quality_profile"] = quality_profile()


def row_lookup():
    return ("select o_orderkey, o_totalprice from orders "
            "where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")


ORACLE["row_lookup"] = row_lookup()


def knn_events():
    return (f"with e as (select * from ({EVH}) where value is not null and k is not null), p as (select a.event_id as q_key, b.event_id as n_key, "
            "sqrt((a.value - b.value) * (a.value - b.value) + (a.k - b.k) * (a.k - b.k)) as distance "
            "from e a, e b where a.split = 'second' and b.split = 'first'), "
            "r as (select *, row_number() over (partition by q_key order by distance, n_key) as rank from p)\n"
            "select q_key, rank, n_key, round(distance, 6) as distance from r where rank <= 10")


ORACLE["knn_events"] = knn_events()


def class_copies():
    return """
with c as (select quality as label, count(*) as n from labels where quality is not null group by 1),
w as (select label, n, max(n) over () / n as ratio from c),
e as (select m, max(abs(round(ratio * m) / m - ratio) / ratio) as err from w, range(1, 9) t(m) group by m),
b as (select coalesce(min(m) filter (where err <= 0.05), arg_min(m, err)) as m from e)
select label, cast(n * round(ratio * m) as bigint) as n_copies from w, b"""


ORACLE["class_copies"] = class_copies()


def _dot(cols, weights, bias) -> str:
    return " + ".join([f"cast({bias} as double)", *[f"{c} * cast({w} as double)" for c, w in zip(cols, weights)]])


def _chain(mode: str) -> str:
    """CTEs up to ``m``: one row per line item with scores, memberships and the meta probability."""
    ctes = ["i0 as (select l_orderkey, l_linenumber, cast(l_returnflag = 'R' as integer) as label, l_quantity, l_extendedprice, "
            "nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem)"]
    for n, (t, (f, w, b)) in enumerate(C.CHAIN_IMPUTERS.items()):
        ctes.append(f"i{n + 1} as (select * replace (coalesce({t}, {_dot(f, w, b)}) as {t}), {t} is null as {t}_imputed from i{n})")
    scaled = ", ".join(f"({c} - {lo}) / ({hi} - {lo}) as {c}" for c, (lo, hi) in C.CHAIN_SCALER.items())
    ctes.append(f"s as (select * replace ({scaled}) from i{len(C.CHAIN_IMPUTERS)})")
    raw = ", ".join((f"1.0 / (1.0 + exp(-({_dot(C.CHAIN, w, b)})))" if k == "probability" else _dot(C.CHAIN, w, b)) + f" as {n}"
                    for n, k, w, b in C.CHAIN_BASE)
    ctes.append(f"b as (select *, {raw} from s)")
    dec = [n for n, k, _, _ in C.CHAIN_BASE if k == "decision"]
    if mode == "batch":
        norm = ", ".join(f"({n} - min({n}) over ()) / ((max({n}) over () - min({n}) over ()) + 1e-8) as {n}" for n in dec)
    else:
        norm = ", ".join(f"greatest(least(({n} - ({C.CHAIN_RANGES[n][0]})) / (({C.CHAIN_RANGES[n][1] - C.CHAIN_RANGES[n][0]}) + 1e-8), 1.0), 0.0) as {n}"
                         for n in dec)
    ctes.append(f"n as (select * replace ({norm}), {', '.join(f'{n} as raw_{n}' for n in dec)} from b)")
    cols = C.CHAIN + [n for n, *_ in C.CHAIN_BASE]
    d = ", ".join("sqrt(" + " + ".join(f"({c} - {x}) * ({c} - {x})" for c, x in zip(cols, centre)) + f") as d{i}" for i, centre in enumerate(C.CHAIN_CENTERS))
    ctes.append(f"d as (select *, {d} from n)")
    ctes.append("u as (select *, case when d0 = 0 or d1 = 0 then cast(d0 = 0 as double) else 1.0 / (pow(d0 / d0, 2) + pow(d0 / d1, 2)) end as u0, "
                "case when d0 = 0 or d1 = 0 then cast(d1 = 0 as double) else 1.0 / (pow(d1 / d0, 2) + pow(d1 / d1, 2)) end as u1 from d)")
    ctes.append(f"m as (select *, 1.0 / (1.0 + exp(-({_dot(cols + ['u0', 'u1'], *C.CHAIN_META)}))) as p_meta from u)")
    return "with " + ",\n".join(ctes)


def score_chain(mode: str) -> str:
    names = [n for n, *_ in C.CHAIN_BASE] + ["u0", "u1", "p_meta"]
    return (f"{_chain(mode)}\nselect l_orderkey, l_linenumber, {', '.join(f'round({n}, 6) as {n}' for n in names)}, "
            "cast(p_meta > 0.5 as integer) as pred, l_tax_imputed, l_discount_imputed from m")


def score_chain_metrics():
    preds = [(n, f"{n} > 0.5" if k == "probability" else f"raw_{n} > 0") for n, k, _, _ in C.CHAIN_BASE] + [("meta", "p_meta > 0.5")]
    long = _union([f"select label, '{n}' as model, cast({p} as integer) as pred from m" for n, p in preds])
    # CTEs come first in a DuckDB statement
    return f"{_chain('fitted')}, long as ({long})\n{_bm('select * from long', 'pred', 'model')}"


ORACLE.update({"score_chain_batch": score_chain("batch"), "score_chain_fitted": score_chain("fitted"), "score_chain_metrics": score_chain_metrics()})


_EMBEDDED = (f"select vec_id, label, unnest(range({C.DIMS})) as k, unnest(embedding)::double as x from embeddings")
_READINGS = f"select vec_id, label, 'd' || lpad(k::varchar, 2, '0') as name, x from ({_EMBEDDED}) where abs(x) >= {C.NOISE}"


def corr_wide():
    names = f"select 'd' || lpad(k::varchar, 2, '0') as name from (select unnest(range({C.DIMS})) as k)"
    return (f"with r as ({_READINGS}), n as ({names}), "
            "p as (select a.name as a, b.name as b, count(*) as n, corr(a.x, b.x) as c from r a join r b using (vec_id) where a.name < b.name group by 1, 2)\n"
            "select x.name as column_a, y.name as column_b, coalesce(p.n, 0) as n_complete, round(p.c, 6) as corr "
            "from n x join n y on x.name < y.name left join p on p.a = x.name and p.b = y.name")


def corr_wide_with_label():
    return (f"select name as column_name, count(*) filter (where label is not null) as n_complete, round(corr(x, label::double), 6) as corr "
            f"from ({_READINGS}) group by 1")


ORACLE.update({"corr_wide": corr_wide(), "corr_wide_with_label": corr_wide_with_label()})
