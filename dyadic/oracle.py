"""DuckDB statements that state, independently of Spark, what each registered
query must return. The driver runs them on the same parquet tables; the test
suite does the same at a small scale factor.

``FIXTURE_CTES`` is the SQL twin of ``dyadic.sources.fixtures``. Doubles are
rounded to 6 places in both engines because summation order differs.
"""

from __future__ import annotations

FIXTURE_CTES = """
fx_pairs_raw as (
  select a.drug1, b.drug2, a.se, a.label, a.c1, b.c2, a.n1 * b.n2 n
  from (select l_orderkey order_key, l_linenumber line_no, l_suppkey drug1,
               cast(l_quantity as integer) % 30 se, case when l_returnflag = 'R' then 1 else 0 end label,
               cast(round(l_extendedprice * 100) as bigint) c1, count(*) n1
        from lineitem group by all) a
  join (select l_orderkey order_key, l_linenumber line_no, l_suppkey drug2,
               cast(round(l_extendedprice * 100) as bigint) c2, count(*) n2
        from lineitem group by all) b
    on a.order_key = b.order_key and a.line_no < b.line_no
  where a.drug1 <> b.drug2),
fx_scored as (
  select (drug1 * 1000000000 + drug2) * 100 + se row_id, drug1, drug2, se,
         case when 3 * sum(label * n) > sum(n) then 1 else 0 end label,
         cast(sum(c1 * n) as double) / sum(n) / 1e7 score_fwd,
         cast(sum(c2 * n) as double) / sum(n) / 1e7 score_rev
  from fx_pairs_raw group by drug1, drug2, se),
fx_pairs as (select row_id, drug1, drug2, se, label from fx_scored),
fx_drug as (
  select s_suppkey drug_id, 'CID' || lpad(cast(s_suppkey as varchar), 9, '0') stitch_id, s_name name
  from supplier),
fx_profile as (
  select vec_id drug_id, cast(embedding as double[]) vec from embeddings),
fx_side_effect as (select n_nationkey se, n_name name from nation),
fx_se_cat as (select distinct cast(l_quantity as integer) % 30 se from lineitem),
fx_threshold as (
  select c.se, cast(r.range as integer) sample_no,
         cast(350 + 5 * cast(r.range as integer) + 3 * c.se as double) / 1000.0 thr
  from fx_se_cat c cross join range(0, 8) r),
fx_screen_threshold as (
  select c.se, cast(r.range as integer) sample_no,
         cast(2600 + 5 * cast(r.range as integer) + 5 * c.se as double) / 1000.0 thr
  from fx_se_cat c cross join range(0, 8) r),
fx_thr_mean as (
  select se, avg(thr) optimal_thr from fx_threshold where sample_no between 1 and 5 group by se),
fx_request as (
  select event_id request_id, ts, user_id drug1, event_id % 1000 drug2 from events)
"""


def q6(expr: str) -> str:
    """Six-place rounding written with IEEE operations only (multiply, add,
    floor, divide), so both engines give the same double; Spark's ``round``
    and DuckDB's ``round`` part on half-way values."""
    return f"(case when abs({expr}) < 1e15 then floor(({expr}) * 1e6 + 0.5) / 1e6 else ({expr}) end)"


def _rewrite_round6(sql: str) -> str:
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        head, sep, tail = inner.rpartition(",")
        if sep and tail.strip() == "6":
            out.append(sql[i:j] + q6(_rewrite_round6(head)))
        else:
            out.append(sql[i:j] + key + _rewrite_round6(inner) + ")")
        i = k


def with_fixtures(*ctes: str, select: str) -> str:
    """``WITH <fixtures>, <ctes...> <select>``; ``round(x, 6)`` is written as
    ``q6(x)``."""
    body = ",\n".join([FIXTURE_CTES.strip()] + [c.strip() for c in ctes])
    return _rewrite_round6(f"with {body}\n{select}")


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) {name or expr}"


def curve_ctes(src: str, score: str, label: str = "label", by: str = "se", prefix: str = "cv",
               out: str | None = None) -> list[str]:
    """CTEs ``{prefix}_pts`` (one row per group and distinct score with the
    curve quantities) and ``{prefix}`` (per group: n_label0, n_label1, auc,
    aupr, optimal_thr, cut counts, medians)."""
    p = prefix
    out = out or (by if by.isidentifier() else "g")
    return [
        f"""{p}_hist as (
  select {by} g, {score} score,
         cast(sum(case when {label} = 0 then 1 else 0 end) as bigint) c0,
         cast(sum(case when {label} = 1 then 1 else 0 end) as bigint) c1
  from {src} where {score} is not null group by {by}, {score})""",
        f"""{p}_scan as (
  select *, sum(c0) over w cum_c0, sum(c1) over w cum_c1,
         sum(c0) over (partition by g) tot_c0, sum(c1) over (partition by g) tot_c1,
         lag(c0) over (partition by g order by score) prev_c0,
         lag(c1) over (partition by g order by score) prev_c1
  from {p}_hist
  window w as (partition by g order by score rows between unbounded preceding and current row))""",
        f"""{p}_pts as (
  select *, tot_c0 - cum_c0 + c0 tps, tot_c1 - cum_c1 + c1 fps,
         (prev_c0 is null or (cum_c0 = tot_c0 and cum_c1 = tot_c1) or c0 <> prev_c0 or c1 <> prev_c1) kept,
         cast(tot_c0 - cum_c0 + c0 as double) / tot_c0 tpr,
         cast(tot_c1 - cum_c1 + c1 as double) / tot_c1 fpr,
         abs(cast(tot_c0 - cum_c0 + c0 as double) / tot_c0 + cast(tot_c1 - cum_c1 + c1 as double) / tot_c1 - 1) obj
  from {p}_scan)""",
        f"""{p}_best as (
  select g, score, cum_c0, cum_c1, obj from (
    select *, row_number() over (partition by g order by obj, score desc) rn from {p}_pts where kept)
  where rn = 1)""",
        f"""{p}_med as (
  select g,
    quantile_cont(score, 0.5) filter (where {label} = 1) median_pos,
    quantile_cont(score, 0.5) filter (where {label} = 0) median_neg
  from (select {by} g, {score} score, {label} from {src} where {score} is not null) group by g)""",
        f"""{p} as (
  select a.g {out}, a.n_label0, a.n_label1,
    case when a.n_label0 > 0 and a.n_label1 > 0 then a.auc_num / (a.n_label0 * a.n_label1) end auc,
    case when a.n_label0 > 0 and a.n_label1 > 0 then a.ap_num / a.n_label0 end aupr,
    case when a.n_label0 > 0 and a.n_label1 > 0 then
      case when b.obj >= 1 then 'inf'::double else b.score end end optimal_thr,
    case when a.n_label0 > 0 and a.n_label1 > 0 then
      case when b.obj >= 1 then a.n_label0 else b.cum_c0 end end cut_le_label0,
    case when a.n_label0 > 0 and a.n_label1 > 0 then
      case when b.obj >= 1 then a.n_label1 else b.cum_c1 end end cut_le_label1,
    m.median_pos, m.median_neg
  from (select g, max(tot_c0) n_label0, max(tot_c1) n_label1,
               sum(c0 * (cum_c1 - cast(c1 as double) / 2)) auc_num,
               sum(c0 * cast(tps as double) / (tps + fps)) ap_num
        from {p}_pts group by g) a
  left join {p}_best b on a.g = b.g
  left join {p}_med m on a.g = m.g)""",
    ]


def perf_ctes(src: str, pred: str, score: str, label: str = "label", prefix: str = "pf") -> list[str]:
    """CTE ``{prefix}``: se, sn, sp, pr, auc, aupr over groups with two classes
    and no missing score (the test-performance table)."""
    p = prefix
    return [
        f"""{p}_prof as (
  select se, count(distinct {label}) n_classes,
         sum(case when {score} is null then 1 else 0 end) n_missing, count(*) n_rows
  from {src} group by se)""",
        f"""{p}_kept as (
  select s.* from {src} s join {p}_prof p on s.se = p.se where p.n_classes > 1 and p.n_missing = 0)""",
        f"""{p}_conf as (
  select se,
    cast(sum(case when {label} = 0 and {pred} = 0 then 1 else 0 end) as bigint) tn,
    cast(sum(case when {label} = 0 and {pred} = 1 then 1 else 0 end) as bigint) fp,
    cast(sum(case when {label} = 1 and {pred} = 0 then 1 else 0 end) as bigint) fn,
    cast(sum(case when {label} = 1 and {pred} = 1 then 1 else 0 end) as bigint) tp
  from {p}_kept group by se)""",
        *curve_ctes(f"{p}_kept", score, label, "se", f"{p}_cv"),
        f"""{p} as (
  select c.se,
    case when tp + fn > 0 then cast(tp as double) / (tp + fn) end sn,
    case when tn + fp > 0 then cast(tn as double) / (tn + fp) end sp,
    case when tp + fp > 0 then cast(tp as double) / (tp + fp) end pr,
    v.auc, v.aupr
  from {p}_conf c join {p}_cv v on c.se = v.se)""",
    ]


MERGED_CTES = [
    """q1_ori as (
  select s.drug1, s.drug2, s.se, s.label, s.score_fwd predicted_score,
         cast(coalesce(s.score_fwd < t.optimal_thr, false) as integer) predicted_label
  from fx_scored s left join fx_thr_mean t on s.se = t.se)""",
    """q1_swi as (
  select s.drug2 drug1, s.drug1 drug2, s.se, s.label, s.score_rev predicted_score,
         cast(coalesce(s.score_rev < t.optimal_thr, false) as integer) predicted_label
  from fx_scored s left join fx_thr_mean t on s.se = t.se)""",
    """q1_merged as (
  select a.drug1, a.drug2, a.se, a.label, a.predicted_label predicted_label_x,
         b.predicted_label predicted_label_y, a.predicted_score predicted_score_x,
         b.predicted_score predicted_score_y,
         (a.predicted_score + b.predicted_score) / 2 mean_predicted_score,
         cast(coalesce((a.predicted_score + b.predicted_score) / 2 < t.optimal_thr, false) as integer)
           final_predicted_label,
         abs((a.predicted_score + b.predicted_score) / 2 - t.optimal_thr) gap,
         a.n * b.n n_copies
  from (select drug1, drug2, se, label, predicted_label, predicted_score, count(*) n from q1_ori group by all) a
  join (select drug1, drug2, se, predicted_label, predicted_score, count(*) n from q1_swi group by all) b
    on a.drug1 = b.drug2 and a.drug2 = b.drug1 and a.se = b.se
  left join fx_thr_mean t on a.se = t.se)""",
]

PERF_COLS = ["sn", "sp", "pr", "auc", "aupr"]


def perf_select(src: str) -> str:
    return "select se, " + ", ".join(r6(c) for c in PERF_COLS) + f" from {src}"


def describe_select(src: str) -> str:
    parts = []
    for m in PERF_COLS:
        parts.append(f"""select '{m}' metric, count({m}) count, {r6(f'avg({m})', 'mean')},
  {r6(f'stddev_samp({m})', 'std')}, {r6(f'min({m})', 'min')},
  {r6(f'quantile_cont({m}, 0.25)', 'q25')}, {r6(f'quantile_cont({m}, 0.5)', 'q50')},
  {r6(f'quantile_cont({m}, 0.75)', 'q75')}, {r6(f'max({m})', 'max')} from {src}""")
    return "\nunion all\n".join(parts)


# ------------------------------------------------ layers with weights by rule
def linear_sql(x: str, n_in: int, n_out: int, salt: int, bias: bool = True, row0: int = 0) -> str:
    """``x @ W + b`` with the index rules of ``scoring.formula_matrix``; ``row0``: first row of W that x meets."""
    b = f" + ((j + {salt}) % 5 - 2)::double / 10" if bias else ""
    return (f"list_transform(range(0, {n_out}), lambda j: list_sum(list_transform(range(0, {n_in}), "
            f"lambda i: ({x})[i + 1] * ((7 * (i + {row0}) + 13 * j + {salt}) % 11 - 5)::double / 20)){b})")


def norm_sql(x: str, n: int) -> str:
    return (f"list_transform(range(0, {n}), lambda j: (({x})[j + 1] - (j % 2)::double / 10) "
            f"/ sqrt(1 + (j % 5)::double / 10 + 0.001::double) * (1 + (j % 3)::double / 10) + ((j % 4) - 1)::double / 10)")


def each_sql(x: str, expr: str) -> str:
    return f"list_transform({x}, lambda z: {expr})"


ELU = "case when z > 0 then z else exp(z) - 1 end"


def feature_model_ctes(src: str, n_fp: int, n_props: int, n_out: int, variant: str, hidden_fp=(12, 6),
                       hidden_pr=(6,)) -> list[str]:
    """CTEs up to ``fm`` (row_id, pred) over ``src`` (row_id, fp, d)."""
    ctes, n, width = [f"fm0 as (select row_id, fp a, d b from {src})"], 0, 0
    parts = []
    for col, n_in, hidden, salt, on in (("a", n_fp, hidden_fp, 1, variant in ("both", "fp")),
                                        ("b", n_props, hidden_pr, 11, variant in ("both", "props"))):
        if not on:
            continue
        for k, h in enumerate(hidden):
            other = "b" if col == "a" else "a"
            relu = each_sql(linear_sql(col, n_in, h, salt + k), "greatest(z, 0)")
            ctes.append(f"fm{n + 1} as (select row_id, {other}, {relu} {col} from fm{n})")
            ctes.append(f"fm{n + 2} as (select row_id, {other}, {norm_sql(col, h)} {col} from fm{n + 1})")
            n, n_in = n + 2, h
        parts.append(col)
        width += n_in
    ctes.append(f"fmc as (select row_id, {' || '.join(parts)} c from fm{n})")
    ctes.append(f"fm as (select row_id, {each_sql(linear_sql('c', width, n_out, 21), '10 * tanh(z)')} pred from fmc)")
    return ctes


def pair_model_ctes(pairs: str, d: int = 64, e: int = 16) -> list[str]:
    """CTEs up to ``pm`` (drug1, drug2, s1, h1, e1, e2) over distinct ``pairs`` (drug1, drug2); per-drug layers are
    computed once per drug."""
    mul = lambda h, a, b, salt: (f"list_transform(range(0, {d}), lambda j: {h}[j + 1] * "  # noqa: E731
                                 f"(1 / (1 + exp(-({a}[j + 1] + {b}[j + 1] + ((j + {salt}) % 5 - 2)::double / 10)))))")
    return [
        f"pm_l as (select drug_id, {each_sql(linear_sql('vec', d, d, 1), ELU)} z1 from fx_profile)",
        f"pm_h as (select drug_id, {norm_sql('z1', d)} h from pm_l)",
        f"""pm_g as (select drug_id, h, {linear_sql('h', d, d, 2, False)} t1, {linear_sql('h', d, d, 2, False, d)} u1,
  {linear_sql('h', d, d, 3, False)} t2, {linear_sql('h', d, d, 3, False, d)} u2 from pm_h)""",
        f"""pm_m as (select p.drug1, p.drug2, a.h h1, {mul('a.h', 'a.t1', 'b.u1', 2)} m1, {mul('b.h', 'a.t2', 'b.u2', 3)} m2
  from {pairs} p left join pm_g a on p.drug1 = a.drug_id left join pm_g b on p.drug2 = b.drug_id)""",
        f"pm_s as (select drug1, drug2, h1, {norm_sql('m1', d)} s1, {norm_sql('m2', d)} s2 from pm_m)",
        f"pm_e as (select drug1, drug2, h1, s1, {linear_sql('s1', d, e, 4)} x1, {linear_sql('s2', d, e, 4)} x2 from pm_s)",
        f"""pm as (select drug1, drug2, s1, h1, {norm_sql(each_sql('x1', ELU), e)} e1, {norm_sql(each_sql('x2', ELU), e)} e2
  from pm_e)"""]


def head_distance_sql(a: str, b: str, e: int = 16, se: str = "se") -> str:
    """``|H a + r - T b|`` of side effect ``se`` with the index rules."""
    w = lambda salt: f"((3 * {se} + 7 * f + 13 * i + {salt}) % 11 - 5)::double / 20"
    diff = (f"list_sum(list_transform(range(0, {e}), lambda i: {a}[i + 1] * {w(5)} - {b}[i + 1] * {w(6)})) "
            f"+ (({se} + f) % 7 - 3)::double / 10")
    return f"sqrt(list_sum(list_transform(range(0, {e}), lambda f: ({diff}) ** 2)))"


def sums_sql(c: str) -> str:
    """Sum and position-weighted sum of a list, rounded."""
    return (f"round(list_sum({c}), 6) {c}_sum, "
            f"round(list_sum(list_transform(range(0, len({c})), lambda j: (j + 1) * {c}[j + 1])), 6) {c}_wsum")
