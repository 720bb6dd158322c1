"""DuckDB SQL oracles for the registered queries (driver views are pre-registered).

The regex pattern strings are shared with the Spark side (Java regex and RE2
accept the same syntax for them); only the group reference differs (``\\1``).
"""

from __future__ import annotations

from ..functions import answers as A
from ..functions import text as T
from . import fixtures as X

ORACLE: dict[str, str] = {}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


# ---------------------------------------------------------------- text expressions

def sql_collapse(x: str) -> str:
    return f"trim({rx(x, T.WS_RUN, ' ')}, ' ')"


def sql_unicode_strip(x: str) -> str:
    return rx(x, f"^{T.WS}+|{T.WS}+$", "")


def sql_ampersand(x: str) -> str:
    return f"replace(replace({x}, '&amp;', ' and '), '&', ' and ')"


def sql_clean(x: str) -> str:
    c = f"coalesce({x}, '')"
    c = rx(c, T.URL_PATTERN, T.URL_TOKEN)
    c = rx(c, T.MENTION_PATTERN, T.USER_TOKEN)
    c = rx(c, T.EMAIL_PATTERN, T.EMAIL_TOKEN)
    c = rx(c, T.HASHTAG_PATTERN, r"\1")
    return sql_collapse(sql_ampersand(c))


# ---------------------------------------------------------------- shared CTEs

CORPUS = f"""corpus AS (
  SELECT d.doc_id AS row_id, d.lang AS dataset,
         {X.SPLIT_RULE.replace('row_id', 'd.doc_id')} AS split,
         d.text AS text, CAST(l.toxic AS INTEGER) AS label, d.n_chars AS n_chars, d.source AS source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

DOCS = f"""docs AS (
  SELECT doc_id AS row_id, lang AS dataset, {X.SPLIT_RULE.replace('row_id', 'doc_id')} AS split,
         text, n_chars, source FROM documents)"""

# every document, named like the labelled corpus
EVERY = DOCS.replace("docs AS", "corpus AS")

DEDUP = """dedup AS (
  SELECT * FROM corpus WHERE split NOT IN ('train', 'validation') OR split IS NULL
  UNION ALL
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY split, text ORDER BY row_id) AS rn
    FROM corpus WHERE split IN ('train', 'validation')) WHERE rn = 1)"""


def runs_cte(src: str, name: str = "runs") -> str:
    parts = [f"SELECT dataset, '{n}' AS experiment, row_id, label, CAST({e} AS DOUBLE) AS p FROM {src}"
             for n, e in X.SCORERS.items()]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


# binary predictions with the probability vector [1 - p, p]
PREDS = runs_cte("corpus") + """,
preds AS (
  SELECT dataset, experiment, row_id, label, [1.0 - p, p] AS probs,
         CASE WHEN p > 1.0 - p THEN 1 ELSE 0 END AS pred
  FROM runs)"""

MULTI = f"""mlog AS (
  SELECT 'emb' AS dataset, 'slice10' AS experiment, vec_id AS row_id, CAST(label AS INTEGER) AS label,
         list_transform(embedding[1:{X.N_MULTI}], lambda x: CAST(x AS DOUBLE)) AS logits
  FROM embeddings),
mexp AS (
  SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM mlog),
mpreds AS (
  SELECT dataset, experiment, row_id, label, logits,
         list_transform(e, lambda x: x / list_sum(e)) AS probs
  FROM mexp),
mpred AS (
  SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM mpreds)"""


def class_stats_cte(src: str, keys: str = "dataset, experiment", name: str = "stats") -> str:
    return f"""{name}_roles AS (
  SELECT {keys}, label AS cls, count(*) AS support, 0 AS predicted,
         sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS tp
  FROM {src} GROUP BY {keys}, label
  UNION ALL
  SELECT {keys}, pred AS cls, 0 AS support, count(*) AS predicted, 0 AS tp
  FROM {src} GROUP BY {keys}, pred),
{name} AS (
  SELECT {keys}, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support,
         CAST(sum(predicted) AS BIGINT) AS predicted
  FROM {name}_roles GROUP BY {keys}, cls)"""


def ratio(num: str, den: str, zd: float = 0.0) -> str:
    return f"CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) ELSE {zd!r} END"


def bin_case(conf: str, n_bins: int = 10) -> str:
    from ..operators.metrics import bin_edges
    e = bin_edges(n_bins)
    whens = " ".join(f"WHEN {conf} > CAST({e[i]!r} AS DOUBLE) AND {conf} <= CAST({e[i + 1]!r} AS DOUBLE) THEN {i}"
                     for i in range(n_bins))
    return f"CASE {whens} END"


def ece_cte(src: str, conf: str, hit: str, keys: str = "dataset, experiment", name: str = "ece") -> str:
    return f"""{name}_rows AS (
  SELECT {keys}, {conf} AS conf, {hit} AS hit FROM {src}),
{name}_bins AS (
  SELECT {keys}, {bin_case('conf')} AS bin, count(*) AS nb, sum(conf) AS sc, sum(hit) AS sh
  FROM {name}_rows GROUP BY ALL),
{name} AS (
  SELECT {keys}, coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(sc / nb - sh / nb) * (nb / n) END), 0.0) AS ece
  FROM (SELECT *, sum(nb) OVER (PARTITION BY {keys}) AS n FROM {name}_bins) GROUP BY {keys})"""


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ---------------------------------------------------------------- flagship

register("scorer_quality", f"""
WITH {CORPUS},
{DEDUP},
cleaned AS (SELECT row_id, dataset, label, length({sql_clean('text')}) AS n_chars FROM dedup),
{runs_cte('cleaned')},
pr AS (SELECT dataset, experiment, row_id, label, p, 1.0 - p AS p0,
             CASE WHEN p > 1.0 - p THEN 1 ELSE 0 END AS pred FROM runs),
{class_stats_cte('pr')},
summ AS (
  SELECT dataset, experiment, sum(tp) / sum(support) AS accuracy,
         avg({ratio('2 * tp', 'support + predicted')}) AS macro_f1
  FROM stats GROUP BY ALL),
{ece_cte('pr', 'greatest(p0, p)', 'CASE WHEN pred = label THEN 1 ELSE 0 END')},
cnt AS (SELECT dataset, experiment, count(*) AS n FROM pr GROUP BY ALL)
SELECT s.dataset, s.experiment, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(e.ece, 6) AS ece, c.n
FROM summ s JOIN ece e USING (dataset, experiment) JOIN cnt c USING (dataset, experiment)
""")


# ---------------------------------------------------------------- §2.7 text functions

def sql_social_tags(x: str) -> str:
    c = f"coalesce({x}, '')"
    c = rx(c, T.URL_PATTERN, T.URL_TOKEN)
    c = rx(c, T.MENTION_PATTERN, T.USER_TOKEN)
    return rx(c, T.EMAIL_PATTERN, T.EMAIL_TOKEN)


# The social tokens, written for this dialect: tags, emoticons, dates, times, phone numbers, money, percentages,
# numbers, acronyms, censored words, words, symbols.
SOCIAL_TOKENS = "|".join([
    "<(?:url|user|email)>",
    r"(?:[:;=](?:-|o|\^|')?[\)\(\]\[\|/\\\*\}\{@\$]+)", r"(?:[:;](?:-|\^|')?[3DOPop]+\b)", r"<3+\b", r"</3+\b", r"\^(?:_|\.|-)?\^",
    r"(?:o|O)(?:_|\.)(?:o|O)\b", r"T_T\b", r"-(?:_|\.)+-", r"(?:x|X)D+\b",
    r"\d\d\d\d[-/.]\d\d?[-/.]\d\d?\b", r"\d\d?[-/.]\d\d?[-/.](?:\d\d\d\d|\d\d)\b",
    r"\d\d?:[0-5]\d(?::[0-5]\d)?(?:(?:a|A|p|P)(?:m|M))?\b",
    r"\+\d[\d().-]{6,}\d\b", r"\(\d{2,3}\)\d{3,5}-\d{4}\b", r"\d{3}-\d{3}-\d{4}\b",
    r"(?:\$|€|£|¥)\d+(?:[,.]\d+)*(?:(?:k|K|m|M|b|B)\b)?", r"\d+(?:[,.]\d+)*(?:\$|€|£|¥)", r"\d+(?:[,.]\d+)*%", r"\d+(?:[,.]\d+)+\b",
    r"(?:\p{Lu}\.)(?:\p{Lu}\.)+(?:\p{Lu}\b)?", r"\p{L}+\*+\p{L}+(?:\*+\p{L}*)*", r"\p{L}+\*\*+",
    r"[\p{L}\p{N}_']+", r"[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"])


def sql_social_tokens(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, {q(SOCIAL_TOKENS)}), ' ')"


def sql_simple(x: str) -> str:
    c = sql_ampersand(f"coalesce({x}, '')")
    return sql_collapse(rx(c, r"[\r\n]+", " "))


def sql_generic(x: str) -> str:
    c = rx(x, T.URL_LOOSE_PATTERN, " ")
    c = rx(c, T.MENTION_PATTERN, " ")
    c = rx(c, T.HASHTAG_PATTERN, r"\1")
    c = f"replace(replace(replace({c}, '&amp;', 'and'), '&lt;', '<'), '&gt;', '>')"
    c = rx(c, T.WS_RUN, " ")
    c = rx(c, T.NON_ASCII_RUN, " ")
    return sql_unicode_strip(c)


def sql_ascii(x: str) -> str:
    c = f"replace(replace(coalesce({x}, ''), '&amp;', 'and'), '&', 'and')"
    c = f"translate({c}, {q(T.CURLY_QUOTES_FROM)}, {q(T.CURLY_QUOTES_TO)})"
    c = rx(c, T.NON_ASCII_RUN, " ")
    return rx(c, " +", " ")


_TEXT_SQL = {
    "clean_text": sql_clean,
    "normalize_mention": lambda x: rx(x, T.MENTION_PATTERN, T.USER_TOKEN),
    "normalize_email": lambda x: rx(x, T.EMAIL_PATTERN, T.EMAIL_TOKEN),
    "unpack_hashtag": lambda x: rx(x, T.HASHTAG_PATTERN, r"\1"),
    "expand_ampersand": sql_ampersand,
    "collapse_whitespace": sql_collapse,
    "simple_preprocess": sql_simple,
}
for _k, _f in _TEXT_SQL.items():
    register(_k, f"SELECT doc_id AS row_id, {_f('text')} AS out FROM documents")

register("normalize_url", f"""SELECT page_id AS row_id, {rx("concat_ws(' ', url, html)", T.URL_PATTERN, T.URL_TOKEN)} AS out
FROM pages""")


def sql_tokens(x: str) -> str:
    s = sql_unicode_strip(f"coalesce({x}, '')")
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, {q(T.WS_RUN)})) END"


register("token_length_stats", f"""
WITH {EVERY},
t AS (SELECT split, {sql_tokens('text')} AS tokens FROM corpus)
SELECT split, max(tokens) AS max_tokens, min(tokens) AS min_tokens, round(avg(tokens), 6) AS mean_tokens,
       count(*) AS texts
FROM t GROUP BY split
UNION ALL
SELECT 'all', max(tokens), min(tokens), round(avg(tokens), 6), count(*) FROM t""")

register("corpus_unigrams", r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT word, count(*) AS count FROM w GROUP BY word""")

from ..functions.prompts import EXAMPLE_TEMPLATE  # noqa: E402
from .catalog import FEW_TEMPLATE, NAMES, ZERO_TEMPLATE  # noqa: E402


def sql_zero(template: str, x: str) -> str:
    return f"replace(replace({q(template)}, '{{text}}', coalesce({x}, '')), '{{examples}}', '')"


register("format_prompt_zero", f"""
WITH {EVERY}
SELECT row_id, {sql_zero(ZERO_TEMPLATE, 'text')} AS prompt FROM corpus""")


def names_case(col: str, names) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(names))
    return f"coalesce(CASE {col} {whens} END, CAST({col} AS VARCHAR))"


FEW_SHOTS = f"""shots AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', CAST(row_id AS VARCHAR))), row_id) AS shot
    FROM corpus WHERE split = 'train') WHERE shot <= 2),
ex AS (
  SELECT string_agg(printf({q(EXAMPLE_TEMPLATE)}, i, coalesce(text, ''), CAST(label AS VARCHAR), {names_case('label', NAMES)}), '' ORDER BY i) AS examples
  FROM (SELECT *, row_number() OVER (ORDER BY label, shot) AS i FROM shots))"""

register("format_prompt_few", f"""
WITH {CORPUS},
{FEW_SHOTS}
SELECT row_id, replace(replace({q(FEW_TEMPLATE)}, '{{examples}}', ex.examples), '{{text}}', coalesce(text, '')) AS prompt
FROM (SELECT doc_id AS row_id, text FROM documents), ex""")

register("attach_examples", f"""
WITH {CORPUS},
{FEW_SHOTS}
SELECT row_id, CAST(length(ex.examples) AS BIGINT) AS examples_chars, md5(ex.examples) AS examples_md5
FROM (SELECT doc_id AS row_id FROM documents), ex""")

from ..functions.prompts import INSTRUCTION_TEMPLATE  # noqa: E402

register("build_instruction_pairs", f"""
WITH {CORPUS}
SELECT row_id, replace({q(INSTRUCTION_TEMPLATE)}, '{{text}}', coalesce(text, '')) AS input_text,
       CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END AS target_text
FROM corpus""")

register("verbalize_label", f"""
WITH {CORPUS}
SELECT row_id, label, CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END AS target FROM corpus""")


def sql_in_range(n: str, k: int) -> str:
    return f"({n} IS NOT NULL AND {n} >= 0 AND {n} < {k})"


def sql_any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def sql_strategies(x: str, k: int, names=None):
    text = f"coalesce({x}, '')"
    stripped = sql_unicode_strip(text)
    low = f"lower({stripped})"
    n1 = f"TRY_CAST(regexp_extract({text}, {q(A.ISOLATED_NUMBER)}, 1) AS BIGINT)"
    n2 = f"TRY_CAST(regexp_extract({text}, {q(A.DIGIT_RUN)}, 0) AS BIGINT)"
    steps = [("isolated_number", sql_in_range(n1, k), n1), ("digit_run", sql_in_range(n2, k), n2)]
    if k == 2:
        pos = f"({sql_any_contains(low, A.POSITIVE_KEYWORDS)} AND NOT {sql_any_contains(low, A.NEGATION_KEYWORDS)})"
        steps += [("keyword_positive", pos, "1"), ("keyword_negative", sql_any_contains(low, A.NEGATIVE_KEYWORDS), "0")]
    for i, n in enumerate(names or []):
        steps.append(("class_name", f"contains({low}, {q(n.lower())})", str(i)))
    n5 = f"TRY_CAST({stripped} AS BIGINT)"
    steps.append(("short_numeric", f"(length({stripped}) <= 3 AND {sql_in_range(n5, k)})", n5))
    return steps


def sql_extract(x: str, k: int, names=None) -> str:
    whens = " ".join(f"WHEN {c} THEN {v}" for _, c, v in sql_strategies(x, k, names))
    return f"CAST(CASE {whens} ELSE 0 END AS INTEGER)"


def sql_outcome(x: str, k: int, names=None) -> str:
    whens = " ".join(f"WHEN {c} THEN '{t}'" for t, c, _ in sql_strategies(x, k, names))
    return f"CASE {whens} ELSE 'fallback' END"


register("extract_label_simple", f"""
SELECT conv_id, turn,
  CAST(CASE WHEN {sql_in_range(f"TRY_CAST(regexp_extract(coalesce(text, ''), {q(A.DIGIT_RUN)}, 0) AS BIGINT)", 2)}
       THEN TRY_CAST(regexp_extract(coalesce(text, ''), {q(A.DIGIT_RUN)}, 0) AS BIGINT) ELSE 0 END AS INTEGER) AS pred
FROM conversations""")

register("extract_label", f"""
SELECT conv_id, turn, {sql_extract('text', 2)} AS pred, {sql_extract('text', 2, ['0', '1'])} AS pred_named,
       {sql_extract('text', 3, ['neutro', 'ofensivo', 'odio'])} AS pred_k3
FROM conversations""")

register("extraction_outcome", f"""
SELECT outcome, count(*) AS n FROM (SELECT {sql_outcome('text', 2, ['0', '1'])} AS outcome FROM conversations)
GROUP BY outcome""")


# ---------------------------------------------------------------- §2.4 metrics

ALL_PREDS = f"""{CORPUS},
{PREDS},
{MULTI},
allp AS (
  SELECT dataset, experiment, row_id, label, pred, probs FROM preds
  UNION ALL SELECT dataset, experiment, row_id, label, pred, probs FROM mpred)"""

K = "dataset, experiment"

register("confusion_matrix", f"""
WITH {ALL_PREDS},
cnt AS (SELECT {K}, label, pred, count(*) AS n FROM allp GROUP BY ALL),
cls AS (SELECT {K}, label AS c FROM allp UNION SELECT {K}, pred FROM allp)
SELECT a.dataset, a.experiment, a.c AS label, b.c AS pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM cls a JOIN cls b USING ({K})
LEFT JOIN cnt ON cnt.dataset = a.dataset AND cnt.experiment = a.experiment AND cnt.label = a.c AND cnt.pred = b.c""")

register("confusion_normalized", f"""
WITH {ALL_PREDS},
cnt AS (SELECT {K}, label, pred, count(*) AS n FROM allp GROUP BY ALL),
cls AS (SELECT {K}, label AS c FROM allp UNION SELECT {K}, pred FROM allp),
cm AS (
  SELECT a.dataset, a.experiment, a.c AS label, b.c AS pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
  FROM cls a JOIN cls b USING ({K})
  LEFT JOIN cnt ON cnt.dataset = a.dataset AND cnt.experiment = a.experiment AND cnt.label = a.c AND cnt.pred = b.c)
SELECT *, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w END, 6) AS share
FROM cm WINDOW w AS (PARTITION BY {K}, label)""")


def report_cte(zd: float = 0.0) -> str:
    return f"""{class_stats_cte('allp')},
rep AS (
  SELECT {K}, cls, {ratio('tp', 'predicted', zd)} AS precision, {ratio('tp', 'support', zd)} AS recall,
         {ratio('2 * tp', 'support + predicted', zd)} AS f1, support, tp, predicted
  FROM stats)"""


register("per_class_report", f"""
WITH {ALL_PREDS},
{report_cte()}
SELECT {K}, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""")

register("classification_report", f"""
WITH {ALL_PREDS},
{report_cte()},
g AS (
  SELECT {K}, sum(tp) / sum(support) AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
         sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
         sum(f1 * support) / sum(support) AS wf, CAST(sum(support) AS DOUBLE) AS n
  FROM rep GROUP BY ALL),
u AS (
  SELECT {K}, CAST(cls AS VARCHAR) AS "row", precision, recall, f1, CAST(support AS DOUBLE) AS support FROM rep
  UNION ALL SELECT {K}, 'accuracy', NULL, NULL, acc, n FROM g
  UNION ALL SELECT {K}, 'macro avg', mp, mr, mf, n FROM g
  UNION ALL SELECT {K}, 'weighted avg', wp, wr, wf, n FROM g)
SELECT {K}, "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(support, 6) AS support FROM u""")


def summary_cte(zd: float = 0.0) -> str:
    return f"""{report_cte(zd)},
summ AS (
  SELECT {K},
    CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(support) AS DOUBLE) AS s, CAST(sum(predicted) AS DOUBLE) AS pp,
    sum(CAST(predicted AS DOUBLE) * support) AS pt, sum(CAST(predicted AS DOUBLE) * predicted) AS p2,
    sum(CAST(support AS DOUBLE) * support) AS t2
  FROM rep GROUP BY ALL)"""


register("macro_f1", f"WITH {ALL_PREDS},\n{summary_cte()}\nSELECT {K}, round(macro_f1, 6) AS macro_f1 FROM summ")
register("accuracy", f"WITH {ALL_PREDS},\n{summary_cte()}\nSELECT {K}, round(accuracy, 6) AS accuracy FROM summ")
register("f1_per_class", f"WITH {ALL_PREDS},\n{report_cte()}\nSELECT {K}, cls, round(f1, 6) AS f1 FROM rep")
register("micro_prf", f"""WITH {ALL_PREDS},
{summary_cte()}
SELECT {K}, round({ratio('c', 'pp')}, 6) AS micro_precision, round({ratio('c', 's')}, 6) AS micro_recall,
       round({ratio('2 * c', 'pp + s')}, 6) AS micro_f1 FROM summ""")
register("macro_prf", f"""WITH {ALL_PREDS},
{summary_cte(1.0)}
SELECT {K}, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
       round(macro_f1, 6) AS macro_f1 FROM summ""")
register("mcc", f"""WITH {ALL_PREDS},
{summary_cte()}
SELECT {K}, round(CASE WHEN (s * s - p2) * (s * s - t2) > 0 THEN (c * s - pt) / sqrt((s * s - p2) * (s * s - t2))
                       ELSE 0.0 END, 6) AS mcc FROM summ""")


def curve_cte(src: str = "allp", classes: str | None = None) -> str:
    where = f"WHERE cls IN ({classes})" if classes else ""
    return f"""ex AS (
  SELECT {K}, label, CAST(generate_subscripts(probs, 1) - 1 AS INTEGER) AS cls, unnest(probs) AS score FROM {src}),
hist AS (
  SELECT {K}, cls, score, CAST(sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN label = cls THEN 0 ELSE 1 END) AS BIGINT) AS neg
  FROM ex {where} GROUP BY ALL),
curve AS (
  SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
         sum(pos) OVER g AS P, sum(neg) OVER g AS N
  FROM hist
  WINDOW w AS (PARTITION BY {K}, cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         g AS (PARTITION BY {K}, cls))"""


AP_CTE = """ap AS (
  SELECT dataset, experiment, cls,
         coalesce(sum(CASE WHEN P > 0 THEN (pos / P) * (cum_pos / (cum_pos + cum_neg)) END), 0.0) AS average_precision
  FROM curve GROUP BY ALL)"""

AUC_CTE = """auc AS (
  SELECT dataset, experiment, cls,
         CASE WHEN max(P) > 0 AND max(N) > 0
              THEN sum(pos * ((N - cum_neg) + neg / 2.0)) / (CAST(max(P) AS DOUBLE) * max(N)) END AS auc
  FROM curve GROUP BY ALL)"""

register("average_precision", f"""WITH {ALL_PREDS},
{curve_cte()},
{AP_CTE}
SELECT {K}, cls, round(average_precision, 6) AS average_precision FROM ap""")

register("roc_auc_binary", f"""WITH {CORPUS},
{PREDS},
{curve_cte('preds', '1')},
{AUC_CTE}
SELECT {K}, round(auc, 6) AS roc_auc FROM auc""")

register("roc_auc_ovr_macro", f"""WITH {ALL_PREDS},
{curve_cte()},
{AUC_CTE}
SELECT {K}, round(CASE WHEN count(auc) = count(*) THEN avg(auc) END, 6) AS roc_auc FROM auc GROUP BY ALL""")

register("pr_curve", f"""WITH {ALL_PREDS},
{curve_cte('allp')}
SELECT {K}, cls, round(score, 6) AS threshold, round(cum_pos / (cum_pos + cum_neg), 6) AS precision,
       round(CASE WHEN P > 0 THEN cum_pos / P ELSE 1.0 END, 6) AS recall FROM curve
UNION ALL
SELECT DISTINCT {K}, cls, NULL, 1.0, 0.0 FROM curve""")

HIT = "CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1 ELSE 0 END"

register("ece", f"""WITH {ALL_PREDS},
{ece_cte('allp', 'list_max(probs)', HIT)}
SELECT {K}, round(ece, 6) AS ece FROM ece""")


def bins_dim(n_bins: int = 10) -> str:
    from ..operators.metrics import bin_edges
    e = bin_edges(n_bins)
    rows = ", ".join(f"({i}, CAST({e[i]!r} AS DOUBLE), CAST({e[i + 1]!r} AS DOUBLE))" for i in range(n_bins))
    return f"bins(bin, bin_lower, bin_upper) AS (VALUES {rows})"


register("calibration_bins", f"""WITH {ALL_PREDS},
{ece_cte('allp', 'list_max(probs)', HIT)},
{bins_dim()},
grp AS (SELECT DISTINCT {K} FROM allp)
SELECT g.dataset, g.experiment, b.bin, round(b.bin_lower, 6) AS bin_lower, round(b.bin_upper, 6) AS bin_upper,
       round(coalesce(e.sc / e.nb, 0.0), 6) AS confidence, round(coalesce(CAST(e.sh AS DOUBLE) / e.nb, 0.0), 6) AS accuracy,
       CAST(coalesce(e.nb, 0) AS BIGINT) AS count
FROM grp g CROSS JOIN bins b
LEFT JOIN ece_bins e ON e.dataset = g.dataset AND e.experiment = g.experiment AND e.bin = b.bin""")

register("weighted_cross_entropy", f"""WITH mpred AS (
  SELECT 'emb' AS dataset, 'whole' AS experiment, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings),
cw AS (SELECT label, count(*) AS n_c FROM mpred GROUP BY label),
w AS (SELECT label, CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c) AS weight FROM cw),
r AS (
  SELECT dataset, experiment, w.weight,
         -(logits[m.label + 1] - (list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))) AS nll
  FROM mpred m JOIN w ON m.label = w.label)
SELECT {K}, round(sum(weight * nll) / sum(weight), 6) AS weighted_cross_entropy, count(*) AS n FROM r GROUP BY ALL""")

# the whole vector as logits
WHOLE = """wexp AS (
  SELECT vec_id AS row_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e
  FROM embeddings),
whole AS (SELECT row_id, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM wexp)"""

register("softmax", f"""WITH {WHOLE}
SELECT row_id, CAST(generate_subscripts(probs, 1) - 1 AS INTEGER) AS cls, round(unnest(probs), 6) AS prob FROM whole""")

register("argmax_label", """
SELECT vec_id AS row_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings""")

register("max_confidence", f"""WITH {WHOLE}
SELECT row_id, round(list_max(probs), 6) AS confidence FROM whole""")

register("prob_slice", f"""WITH {WHOLE}
SELECT row_id, CAST(generate_subscripts(probs[1:3], 1) - 1 AS INTEGER) AS cls, round(unnest(probs[1:3]), 6) AS prob
FROM whole""")


# ---------------------------------------------------------------- §2.2 / §2.3 projections and joins

register("join_text_labels", """SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")

register("align_predictions", f"""WITH {CORPUS},
{PREDS}
SELECT c.row_id, c.label, p.pred FROM corpus c JOIN preds p ON c.row_id = p.row_id WHERE p.experiment = 'e3'""")

register("union_corpora", f"""WITH {CORPUS}
SELECT 'documents' AS origin, row_id, label, CAST(length(text) AS BIGINT) AS chars FROM corpus
UNION ALL
SELECT 'benchmark', item_id, CAST(NULL AS INTEGER), CAST(length(text) AS BIGINT) FROM benchmark""")

register("project_text_label", f"WITH {CORPUS}\nSELECT text, label FROM corpus")

register("canonical_rename", """SELECT d.doc_id, d.text AS text, l.toxic AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")

register("binarize_label", """SELECT conv_id, turn, CASE WHEN role IS NOT DISTINCT FROM 'assistant' THEN 1 ELSE 0 END AS label
FROM conversations""")

register("drop_null_rows", """SELECT d.doc_id, l.toxic AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL""")

register("drop_all_null_columns", """SELECT d.doc_id, d.lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")

register("cast_label", "SELECT CAST(doc_id AS VARCHAR) AS text, CAST(quality AS INTEGER) AS label FROM labels")

register("filter_class", f"WITH {CORPUS}\nSELECT row_id, dataset FROM corpus WHERE label = 1")

register("label_name_lookup", f"""WITH {CORPUS},
n AS (SELECT row_id, CASE label {' '.join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(NAMES))} END AS name FROM corpus)
SELECT row_id, name, CASE name {' '.join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(NAMES))} END AS label FROM n""")

register("add_row_index", f"""WITH {EVERY}
SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS index FROM corpus""")

register("sort_by_index", f"""WITH {CORPUS},
{PREDS}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS index, pred AS prediction FROM preds WHERE experiment = 'e3'""")


# ---------------------------------------------------------------- §2.4 corpus aggregations

TRAIN = f"""{CORPUS},
train AS (SELECT * FROM corpus WHERE split = 'train')"""

register("class_distribution", f"""WITH {TRAIN},
g AS (SELECT label, count(*) AS count FROM train GROUP BY label)
SELECT label, count, round(count * 100.0 / sum(count) OVER (), 6) AS percent,
       {names_case('label', NAMES)} AS name FROM g""")

register("class_weights_balanced", f"""WITH {TRAIN},
g AS (SELECT label, count(*) AS n_c FROM train GROUP BY label)
SELECT label, n_c, round(CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c), 6) AS weight FROM g""")

register("class_weights_inverse", f"""WITH {TRAIN},
g AS (SELECT label, count(*) AS n_c FROM train GROUP BY label)
SELECT label, n_c, round(CAST(sum(n_c) OVER () AS DOUBLE) / n_c, 6) AS weight FROM g""")

register("minority_class", f"""WITH {CORPUS},
g AS (SELECT label, count(*) AS n FROM corpus GROUP BY label)
SELECT (SELECT label FROM g ORDER BY n, label LIMIT 1) AS minority_label, min(n) AS minority_count FROM g""")

register("null_profile", """WITH j AS (
  SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT CAST(sum(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS doc_id,
             CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS text,
             CAST(sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lang,
             CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS quality,
             CAST(sum(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS toxic FROM j)
SELECT *, doc_id + text + lang + quality + toxic AS total_nulls, doc_id + text + lang + quality + toxic > 0 AS has_nulls
FROM s""")

register("duplicate_count", """WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) AS distinct_values FROM g""")

def profile_sql(c: str, number: bool) -> str:
    of_number = {"mean": f"avg({c})", "stddev": f"stddev_samp({c})", "min": f"CAST(min({c}) AS DOUBLE)", "p25": f"quantile_cont({c}, 0.25)",
                 "p50": f"quantile_cont({c}, 0.5)", "p75": f"quantile_cont({c}, 0.75)", "max": f"CAST(max({c}) AS DOUBLE)"}
    of_text = {"mean_length": f"round(avg(length({c})), 6)", "min_length": f"min(length({c}))", "max_length": f"max(length({c}))"}
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count,
  {', '.join(f"{'NULL' if number else x} AS {k}" for k, x in of_text.items())},
  {', '.join(f"{f'round({x}, 6)' if number else 'NULL'} AS {k}" for k, x in of_number.items())} FROM documents"""


register("column_profile", "\nUNION ALL\n".join(profile_sql(c, c in ("doc_id", "n_chars")) for c in ("doc_id", "n_chars", "text", "lang", "source")))

SPLIT3 = f"""o AS (
  SELECT row_id, row_number() OVER (ORDER BY md5(concat('42-', CAST(row_id AS VARCHAR))), row_id) AS rn,
         count(*) OVER () AS n FROM corpus),
t AS (SELECT *, CAST(ceil(CAST(n AS DOUBLE) * 0.25) AS BIGINT) AS nt FROM o),
v AS (SELECT *, CAST(ceil(CAST(n - nt AS DOUBLE) * 0.2) AS BIGINT) AS nv FROM t),
sp AS (SELECT row_id, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'validation' ELSE 'train' END AS split FROM v)"""

register("random_split", f"WITH {EVERY},\n{SPLIT3}\nSELECT row_id, split FROM sp")

register("split_conservation", f"""WITH {EVERY},
{SPLIT3},
g AS (SELECT split, count(*) AS n FROM sp GROUP BY split)
SELECT CAST(sum(CASE WHEN split = 'train' THEN n ELSE 0 END) AS BIGINT) AS train,
       CAST(sum(CASE WHEN split = 'validation' THEN n ELSE 0 END) AS BIGINT) AS validation,
       CAST(sum(CASE WHEN split = 'test' THEN n ELSE 0 END) AS BIGINT) AS test,
       CAST(sum(n) AS BIGINT) AS total, true AS conserved FROM g""")

register("stratified_split", f"""WITH {CORPUS},
cc AS (SELECT label, count(*) AS n_c FROM corpus GROUP BY label),
tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST(sum(n_c) AS DOUBLE) * 0.25) AS BIGINT) AS total FROM cc),
ex AS (SELECT label, CAST(total * n_c AS DOUBLE) / n AS exact FROM cc, tot),
fl AS (SELECT label, CAST(floor(exact) AS BIGINT) AS base, exact - floor(exact) AS frac FROM ex),
lf AS (SELECT (SELECT total FROM tot) - sum(base) AS left_ FROM fl),
qt AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, label) <= (SELECT left_ FROM lf)
                                 THEN 1 ELSE 0 END AS quota FROM fl),
o AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', CAST(row_id AS VARCHAR))), row_id) AS rn
      FROM corpus)
SELECT row_id, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM o JOIN qt USING (label)""")


# ---------------------------------------------------------------- §2.5 window-style operators

register("dedup_keep_first", f"""WITH {DOCS}
SELECT row_id, split FROM docs WHERE split NOT IN ('train', 'validation') OR split IS NULL
UNION ALL
SELECT row_id, split FROM (
  SELECT *, row_number() OVER (PARTITION BY split, text ORDER BY row_id) AS rn FROM docs
  WHERE split IN ('train', 'validation')) WHERE rn = 1""")

register("few_shot_sample", f"""WITH {CORPUS}
SELECT label, shot, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', CAST(row_id AS VARCHAR))), row_id) AS shot
  FROM corpus WHERE split = 'train') WHERE shot <= 3""")

register("batch_assignment", f"""WITH {EVERY}
SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 16) AS BIGINT) AS batch FROM corpus""")

register("length_bucketed_batches", f"""WITH {DOCS},
b AS (SELECT row_id, n_chars, CAST(floor(n_chars / 1000) AS BIGINT) AS length_bucket FROM docs)
SELECT row_id, n_chars, length_bucket,
       CAST(floor((row_number() OVER (PARTITION BY length_bucket ORDER BY row_id) - 1) / 8) AS BIGINT) AS batch_in_bucket
FROM b""")

register("length_grouped_batches", f"""WITH {DOCS},
o AS (SELECT row_id, coalesce(n_chars, 0) AS n_chars, row_number() OVER (ORDER BY md5('42-' || row_id), row_id) - 1 AS rn FROM docs),
p AS (SELECT *, rn // 160 * 160 + row_number() OVER (PARTITION BY rn // 160 ORDER BY n_chars DESC, rn) - 1 AS pl FROM o),
l AS (SELECT pl AS longest FROM p ORDER BY n_chars DESC, rn LIMIT 1),
b AS (SELECT row_id, n_chars, CASE pl WHEN longest THEN 0 WHEN 0 THEN longest ELSE pl END AS place FROM p, l),
g AS (SELECT *, place // 8 AS batch FROM b),
c AS (SELECT n_chars, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch FROM o),
share AS (SELECT (sum(m * n) - sum(s)) / sum(m * n) AS share FROM (SELECT max(n_chars) AS m, count(*) AS n, sum(n_chars) AS s FROM g GROUP BY batch)),
plain AS (SELECT (sum(m * n) - sum(s)) / sum(m * n) AS plain_share FROM (SELECT max(n_chars) AS m, count(*) AS n, sum(n_chars) AS s FROM c GROUP BY batch))
SELECT row_id, n_chars, place, batch, round(share, 6) AS share, round(plain_share, 6) AS plain_share FROM g, share, plain""")

register("own_test_split", f"""WITH {EVERY},
o AS (SELECT row_id, row_number() OVER (ORDER BY md5('42-' || row_id), row_id) AS rn, count(*) OVER () AS n FROM corpus WHERE split <> 'test')
SELECT row_id, CASE WHEN rn <= ceil(n * 0.2) THEN 'validation' ELSE 'train' END AS part FROM o
UNION ALL SELECT row_id, 'test' FROM corpus WHERE split = 'test'""")

EPOCHS = """epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value
  FROM events WHERE value IS NOT NULL)"""

register("best_checkpoint", f"""WITH {EPOCHS}
SELECT run, epoch AS best_epoch, round(value, 6) AS best_value, epochs FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) AS r, count(*) OVER (PARTITION BY run) AS epochs
  FROM epochs) WHERE r = 1""")

register("early_stop_epoch", f"""WITH {EPOCHS},
p AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM epochs),
i AS (SELECT *, max(CASE WHEN prev IS NULL OR value > prev THEN epoch END)
                 OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM p)
SELECT run, min(CASE WHEN epoch - last_imp >= 5 THEN epoch END) AS stop_epoch, count(*) AS epochs FROM i GROUP BY run""")


# ---------------------------------------------------------------- §2.6 / §2.9 run tables

BIN_PREDS = f"""{CORPUS},
{PREDS}"""

RECORDS = f"""{class_stats_cte('preds')},
rep AS (
  SELECT {K}, cls, {ratio('tp', 'predicted')} AS precision, {ratio('tp', 'support')} AS recall,
         {ratio('2 * tp', 'support + predicted')} AS f1, support, tp, predicted FROM stats),
{curve_cte('preds')},
{AP_CTE},
{AUC_CTE},
{ece_cte('preds', 'list_max(probs)', HIT)},
results AS (
  SELECT r.dataset, r.experiment, r.macro_f1, r.accuracy, a.macro_avg_precision, u.auc AS roc_auc, e.ece,
         r.f1_0, r.f1_1, r.precision_0, r.precision_1, r.recall_0, r.recall_1, a.ap_0, a.ap_1
  FROM (SELECT {K}, avg(f1) AS macro_f1, sum(tp) / sum(support) AS accuracy,
               max(CASE WHEN cls = 0 THEN f1 END) AS f1_0, max(CASE WHEN cls = 1 THEN f1 END) AS f1_1,
               max(CASE WHEN cls = 0 THEN precision END) AS precision_0, max(CASE WHEN cls = 1 THEN precision END) AS precision_1,
               max(CASE WHEN cls = 0 THEN recall END) AS recall_0, max(CASE WHEN cls = 1 THEN recall END) AS recall_1
        FROM rep GROUP BY ALL) r
  JOIN (SELECT {K}, avg(average_precision) AS macro_avg_precision,
               max(CASE WHEN cls = 0 THEN average_precision END) AS ap_0,
               max(CASE WHEN cls = 1 THEN average_precision END) AS ap_1 FROM ap GROUP BY ALL) a USING ({K})
  JOIN (SELECT * FROM auc WHERE cls = 1) u USING ({K})
  JOIN ece e USING ({K})),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY macro_f1 DESC NULLS LAST, experiment) AS rank FROM results)"""

RESULT_COLS = ["macro_f1", "accuracy", "macro_avg_precision", "roc_auc", "ece", "f1_0", "f1_1",
               "precision_0", "precision_1", "recall_0", "recall_1", "ap_0", "ap_1"]


def rnd(cols, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)


register("flatten_metric_maps", f"WITH {BIN_PREDS},\n{RECORDS}\nSELECT {K}, {rnd(RESULT_COLS)} FROM results")

register("evaluate_runs", f"""WITH {ALL_PREDS},
{class_stats_cte('allp')},
rep AS (SELECT {K}, cls, {ratio('tp', 'predicted')} AS precision, {ratio('tp', 'support')} AS recall,
               {ratio('2 * tp', 'support + predicted')} AS f1, support, tp FROM stats),
lines AS (
  SELECT {K}, CAST(cls AS VARCHAR) AS line, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM rep
  UNION ALL SELECT {K}, 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS DOUBLE) FROM rep GROUP BY ALL
  UNION ALL SELECT {K}, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS DOUBLE) FROM rep GROUP BY {K}
  UNION ALL SELECT {K}, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS DOUBLE) FROM rep GROUP BY {K}),
texts AS (
  SELECT {K}, concat_ws(':', line, coalesce(CAST(CAST(round(precision * 1e6) AS BIGINT) AS VARCHAR), ''),
                        coalesce(CAST(CAST(round(recall * 1e6) AS BIGINT) AS VARCHAR), ''),
                        coalesce(CAST(CAST(round(f1 * 1e6) AS BIGINT) AS VARCHAR), ''), CAST(CAST(support * 1e6 AS BIGINT) AS VARCHAR)) AS t FROM lines),
report AS (SELECT {K}, string_agg(t, ',' ORDER BY t) AS report FROM texts GROUP BY {K}),
{curve_cte('allp')},
{AP_CTE},
{AUC_CTE},
{ece_cte('allp', 'list_max(probs)', HIT)},
kk AS (SELECT {K}, max(len(probs)) AS k FROM allp GROUP BY ALL),
aucx AS (
  SELECT {K}, CASE WHEN max(k) = 2 THEN max(CASE WHEN cls = 1 THEN auc END)
                   ELSE CASE WHEN count(auc) = count(*) THEN avg(auc) END END AS roc_auc
  FROM auc JOIN kk USING ({K}) GROUP BY ALL),
cnt AS (SELECT {K}, label, pred, count(*) AS n FROM allp GROUP BY ALL),
cls AS (SELECT {K}, label AS c FROM allp UNION SELECT {K}, pred FROM allp),
cm AS (
  SELECT a.dataset, a.experiment, a.c AS label, b.c AS pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
  FROM cls a JOIN cls b USING ({K})
  LEFT JOIN cnt ON cnt.dataset = a.dataset AND cnt.experiment = a.experiment AND cnt.label = a.c AND cnt.pred = b.c),
cmrows AS (SELECT {K}, label, list(n ORDER BY pred) AS r FROM cm GROUP BY ALL),
cma AS (SELECT {K}, CAST(to_json(list(r ORDER BY label)) AS VARCHAR) AS confusion_matrix FROM cmrows GROUP BY ALL)
SELECT s.dataset, s.experiment, round(s.macro_f1, 6) AS macro_f1, round(s.accuracy, 6) AS accuracy,
       round(a.macro_avg_precision, 6) AS macro_avg_precision, round(x.roc_auc, 6) AS roc_auc,
       round(e.ece, 6) AS expected_calibration_error, c.confusion_matrix, report.report
FROM (SELECT {K}, avg(f1) AS macro_f1, sum(tp) / sum(support) AS accuracy FROM rep GROUP BY ALL) s
JOIN (SELECT {K}, avg(average_precision) AS macro_avg_precision FROM ap GROUP BY ALL) a USING ({K})
JOIN aucx x USING ({K}) JOIN ece e USING ({K}) JOIN cma c USING ({K}) JOIN report USING ({K})""")

CM_COLS = ["macro_f1", "accuracy", "macro_avg_precision", "roc_auc", "ece", "f1_0", "f1_1", "ap_0", "ap_1"]
register("compare_models", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment AS model, rank, {rnd(CM_COLS)} FROM ranked""")

register("rank_experiments", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment, rank, round(macro_f1, 6) AS macro_f1 FROM ranked""")


def long_cte(cols, src: str = "ranked", name: str = "lm") -> str:
    parts = [f"SELECT dataset, experiment, rank, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


BEST_METRICS = ["macro_f1", "accuracy", "macro_avg_precision", "roc_auc", "f1_0", "f1_1", "ap_0", "ap_1", "ece"]
register("best_method_per_metric", f"""WITH {BIN_PREDS},
{RECORDS},
{long_cte(BEST_METRICS)}
SELECT dataset, metric, experiment, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, metric
                               ORDER BY CASE WHEN metric = 'ece' THEN value ELSE -value END, rank) AS r
  FROM lm WHERE value IS NOT NULL) WHERE r = 1""")

STAT_METRICS = ["macro_f1", "accuracy", "roc_auc", "ece"]
register("metric_statistics", f"""WITH {BIN_PREDS},
{RECORDS},
{long_cte(STAT_METRICS)},
o AS (SELECT *, row_number() OVER (PARTITION BY dataset, metric ORDER BY CASE WHEN metric = 'ece' THEN value ELSE -value END, rank) AS rb,
              row_number() OVER (PARTITION BY dataset, metric ORDER BY CASE WHEN metric = 'ece' THEN -value ELSE value END, rank) AS rw
      FROM lm WHERE value IS NOT NULL),
bw AS (SELECT dataset, metric, max(CASE WHEN rb = 1 THEN value END) AS best, max(CASE WHEN rb = 1 THEN experiment END) AS best_experiment,
              max(CASE WHEN rw = 1 THEN value END) AS worst, max(CASE WHEN rw = 1 THEN experiment END) AS worst_experiment
       FROM o GROUP BY ALL),
st AS (SELECT dataset, metric, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std FROM lm GROUP BY ALL)
SELECT dataset, metric, round(best, 6) AS best, best_experiment, round(worst, 6) AS worst, worst_experiment,
       round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std
FROM st LEFT JOIN bw USING (dataset, metric)""")

register("minmax_scaled_metrics", f"""WITH {BIN_PREDS},
{RECORDS},
{long_cte(RESULT_COLS)},
v AS (SELECT *, CASE WHEN metric = 'ece' THEN max(value) OVER w - value ELSE value END AS v FROM lm
      WINDOW w AS (PARTITION BY dataset, metric)),
m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM v WINDOW w AS (PARTITION BY dataset, metric))
SELECT dataset, experiment, metric, round(value, 6) AS raw,
       round(CASE WHEN hi - lo > 0 THEN (v - lo) / (hi - lo) ELSE v - lo END, 6) AS scaled FROM m""")

register("melt_class_f1", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment, '0' AS class, round(f1_0, 6) AS f1 FROM results
UNION ALL SELECT dataset, experiment, '1', round(f1_1, 6) FROM results""")

register("select_by_prefix", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment, {rnd(['f1_0', 'f1_1', 'ap_0', 'ap_1'])} FROM results""")


def fmt_sql(c: str, digits: int = 4, missing: str = "N/A") -> str:
    return f"coalesce(printf('%.{digits}f', {c}), '{missing}')"


register("summary_table", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment, {fmt_sql('macro_f1')} AS macro_f1, {fmt_sql('accuracy')} AS accuracy FROM results""")

DET = ["macro_f1", "accuracy", "macro_avg_precision", "roc_auc", "ece", "f1_0", "f1_1"]
register("detailed_table", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment, {', '.join(f"{fmt_sql(c)} AS {c}" for c in DET)} FROM results""")

CLS = ["f1_0", "f1_1", "precision_0", "precision_1", "recall_0", "recall_1", "ap_0", "ap_1"]
register("class_table", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment, {', '.join(f"{fmt_sql(c)} AS {c}" for c in CLS)} FROM results""")

LATEX = ["macro_f1", "accuracy", "roc_auc", "ece", "f1_0", "f1_1"]


def latex_cell(c: str) -> str:
    good = c if c == "ece" else f"-{c}"
    s = fmt_sql(c, 3, "---")
    best = (f"(row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN {c} IS NOT NULL THEN {good} END NULLS LAST, rank) = 1"
            f" AND {c} IS NOT NULL)")
    return f"CASE WHEN {best} THEN concat('\\textbf{{', {s}, '}}') ELSE {s} END"


register("report_latex_rows", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, rank, concat(concat_ws(' & ', experiment, {', '.join(latex_cell(c) for c in LATEX)}), ' \\\\') AS line
FROM ranked""")

MD = ["macro_f1", "accuracy", "roc_auc", "ece"]
register("report_markdown_rows", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, rank, concat('| ', concat_ws(' | ', experiment, {', '.join(fmt_sql(c, 4, '---') for c in MD)}), ' |') AS line
FROM ranked""")

CMP = ["macro_f1", "accuracy", "roc_auc", "ece", "f1_0", "f1_1"]
CMP_CTE = f"""{long_cte(CMP)},
pv AS (SELECT dataset, metric, max(CASE WHEN experiment = 'e3' THEN value END) AS v1,
              max(CASE WHEN experiment = 'e1' THEN value END) AS v2,
              max(CASE WHEN experiment = 'e3' THEN 1 ELSE 0 END) AS h1, max(CASE WHEN experiment = 'e1' THEN 1 ELSE 0 END) AS h2
       FROM lm GROUP BY ALL HAVING h1 = 1 AND h2 = 1)"""

register("compare_two_methods", f"""WITH {BIN_PREDS},
{RECORDS},
{CMP_CTE}
SELECT dataset, metric, round(v1, 6) AS v1, round(v2, 6) AS v2, round(v1 - v2, 6) AS diff,
       coalesce(CASE WHEN metric = 'ece' THEN v1 - v2 < 0 ELSE v1 - v2 > 0 END, false) AS method1_wins FROM pv""")

register("diff_format", f"""WITH {BIN_PREDS},
{RECORDS},
{CMP_CTE}
SELECT dataset, metric, printf('%+.4f', v1 - v2) AS diff FROM pv""")


def display_sql(x: str) -> str:
    # initcap equivalent for these names: words are split on spaces only
    words = f"string_split(replace({x}, '_', ' '), ' ')"
    c = f"array_to_string(list_transform({words}, lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"
    for a, b in T.DISPLAY_RENAMES:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


register("metric_display_name", f"""WITH m(metric) AS (VALUES {', '.join(f"('{c}')" for c in RESULT_COLS)})
SELECT metric, {display_sql('metric')} AS display FROM m""")

register("filter_experiment", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT dataset, experiment, round(macro_f1, 6) AS macro_f1 FROM results WHERE experiment = 'e3'""")

register("cross_dataset_eval", f"""WITH {BIN_PREDS},
rates AS (SELECT dataset AS train_dataset, avg(label) AS threshold FROM corpus WHERE split <> 'test' GROUP BY dataset),
test AS (SELECT p.dataset AS test_dataset, p.row_id, p.label, p.probs FROM preds p JOIN corpus c ON c.row_id = p.row_id
         WHERE p.experiment = 'e3' AND c.split = 'test'),
pr AS (SELECT r.train_dataset, t.test_dataset, t.label,
              CAST(t.probs[2] >= 1.0 - r.threshold AS INTEGER) AS pred
       FROM test t JOIN rates r ON r.train_dataset <> t.test_dataset),
{class_stats_cte('pr', 'train_dataset, test_dataset')}
SELECT train_dataset, test_dataset, round(sum(tp) / sum(support), 6) AS accuracy,
       round(avg({ratio('2 * tp', 'support + predicted')}), 6) AS macro_f1
FROM stats GROUP BY ALL""")


# ---------------------------------------------------------------- §2.1 sources and sinks

register("read_corpus_csv", f"WITH {CORPUS}\nSELECT split, row_id, text, label FROM corpus")
register("write_split_csv", f"WITH {CORPUS}\nSELECT split, row_id, text, label FROM corpus")
register("read_delimited", f"WITH {CORPUS}\nSELECT row_id, text, label FROM corpus")
register("read_json_corpus", f"WITH {CORPUS}\nSELECT 'train' AS split, row_id, text, label FROM corpus")
register("read_named_split", f"WITH {CORPUS}\nSELECT row_id, label FROM corpus WHERE split = 'test'")
register("write_metric_json", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT {K}, {rnd(['macro_f1', 'accuracy', 'macro_avg_precision', 'roc_auc', 'ece'])} FROM results""")
register("scan_result_records", f"WITH {BIN_PREDS},\n{RECORDS}\nSELECT {K}, {rnd(RESULT_COLS)} FROM results")
register("broken_result_records", f"""WITH {BIN_PREDS},
{RECORDS}
SELECT {K}, CASE WHEN experiment = 'e2' THEN 'malformed record' END AS error,
       CASE WHEN experiment <> 'e2' THEN round(macro_f1, 6) END AS macro_f1 FROM results""")
register("file_order_ids", f"""WITH {CORPUS}
SELECT split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, row_id) - 1 AS row_id,
       text, label FROM corpus""")
register("write_submission_jsonl", f"""WITH {BIN_PREDS}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS index, pred AS prediction FROM preds WHERE experiment = 'e3'""")
register("write_prediction_csv", f"""WITH {BIN_PREDS},
e3 AS (SELECT * FROM preds WHERE experiment = 'e3'),
{class_stats_cte('e3', 'experiment')},
m AS (SELECT sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(predicted::DOUBLE * support) AS pt, sum(predicted::DOUBLE * predicted) AS p2,
             sum(support::DOUBLE * support) AS t2, avg({ratio('2 * tp', 'support + predicted')}) AS macro_f1, sum(predicted) AS pp
      FROM stats GROUP BY experiment)
SELECT label AS "True", pred AS "Prediction", count(*) AS n, NULL AS "Macro_F1", NULL AS "Micro_F1", NULL AS "Accuracy", NULL AS "MCC"
FROM e3 GROUP BY ALL
UNION ALL
SELECT NULL, NULL, NULL, round(macro_f1, 6), round(2 * c / (pp + s), 6), round(c / s, 6),
       round(CASE WHEN (s * s - p2) * (s * s - t2) > 0 THEN (c * s - pt) / sqrt((s * s - p2) * (s * s - t2)) ELSE 0 END, 6) FROM m""")


def long_rows(table: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS \"table\", dataset, experiment, '{c}' AS \"column\", {fmt_sql(c)} AS value FROM results"
                              for c in columns)


register("write_result_tables", f"""WITH {BIN_PREDS},
{RECORDS}
{long_rows('all_results', RESULT_COLS)}
UNION ALL {long_rows('summary_results', ['macro_f1', 'accuracy'])}
UNION ALL {long_rows('detailed_results', DET)}""")


# ---------------------------------------------------------------- §2.9 model-facing jobs

register("score_batches", f"""WITH {EVERY},
l AS (SELECT row_id, [0.0, ((length(text) % 11) - 5) / 2.0] AS logits FROM corpus),
e AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM l),
p AS (SELECT row_id, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM e)
SELECT row_id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred, round(probs[2], 6) AS p1 FROM p""")


# ---------------------------------------------------------------- §2.8 token ids

from ..operators import tokens as TKN  # noqa: E402

VOCAB = f"""vt AS (
  SELECT unnest(regexp_extract_all(lower(concat_ws(' ', text, CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END)),
                                   {q(TKN.TOKEN_PATTERN)})) AS token
  FROM corpus WHERE split = 'train'),
vocab AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 + {len(TKN.SPECIALS)} AS id, count(*) AS count
  FROM vt GROUP BY token)"""


def enc_cte(src: str, name: str, max_length: int) -> str:
    return f"""{name}_t AS (
  SELECT row_id, unnest(tk) AS token, unnest(generate_series(0, len(tk) - 1)) AS pos
  FROM (SELECT row_id, regexp_extract_all(lower(coalesce(text, '')), {q(TKN.TOKEN_PATTERN)}) AS tk FROM {src})),
{name}_i AS (
  SELECT t.row_id, list(coalesce(v.id, {TKN.UNK_ID}) ORDER BY t.pos) AS ids
  FROM {name}_t t LEFT JOIN vocab v ON v.token = t.token WHERE t.pos < {max_length} GROUP BY t.row_id),
{name} AS (
  SELECT s.row_id, coalesce(i.ids, []) AS ids FROM {src} s LEFT JOIN {name}_i i ON i.row_id = s.row_id)"""


def pad_right(ids: str, L: int) -> str:
    return f"list_concat({ids}, list_transform(range({L} - len({ids})), lambda x: {TKN.PAD_ID}))"


def pad_left(ids: str, L: int) -> str:
    return f"list_concat(list_transform(range({L} - len({ids})), lambda x: {TKN.PAD_ID}), {ids})"


register("corpus_vocabulary", f"""
WITH every AS (SELECT unnest(regexp_extract_all(lower(text), {q(TKN.TOKEN_PATTERN)})) AS token FROM documents)
SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id, count(*) AS count FROM every GROUP BY token""")

register("encode_tokens", f"""WITH {CORPUS},
{VOCAB},
test AS (SELECT doc_id AS row_id, text FROM documents),
{enc_cte('test', 'enc', 256)}
SELECT row_id, array_to_string({pad_right('ids', 256)}, ' ') AS input_ids,
       array_to_string({pad_left('ids', 256)}, ' ') AS left_ids, CAST(len(ids) AS INTEGER) AS n_tokens FROM enc""")

register("align_target_labels", f"""WITH {CORPUS},
{VOCAB},
tg AS (SELECT row_id, CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END AS text FROM corpus),
{enc_cte('tg', 'enc', 8)},
p AS (SELECT row_id, {pad_right('ids', 8)} AS ids FROM enc)
SELECT row_id, array_to_string(list_concat(list_transform(range(256 - least(len(ids), 256)), lambda x: -100),
                                           ids[len(ids) - least(len(ids), 256) + 1:]), ' ') AS labels FROM p""")

register("stream_clean_text", f"SELECT doc_id AS row_id, {sql_clean('text')} AS out FROM documents")


# ---------------------------------------------------------------- workflow entry points

register("load_data", f"""WITH {CORPUS},
{DEDUP}
SELECT split, row_id, {sql_clean('text')} AS text, label FROM dedup""")

register("load_synthetic", f"""WITH src AS (
  SELECT conv_id * 1000 + turn AS row_id, text,
         CASE WHEN role IS NOT DISTINCT FROM 'assistant' THEN 1 ELSE 0 END AS label FROM conversations),
corpus AS (SELECT row_id, {sql_simple('CAST(text AS VARCHAR)')} AS text, CAST(label AS INTEGER) AS label
           FROM src WHERE text IS NOT NULL),
{SPLIT3}
SELECT c.row_id, c.text, c.label, sp.split FROM corpus c JOIN sp USING (row_id)""")


register("prompted_classification", f"""WITH {CORPUS},
pr AS (SELECT row_id, dataset, label, {sql_zero(ZERO_TEMPLATE, 'text')} AS prompt FROM corpus),
g AS (SELECT row_id, dataset, label, concat('Classe: ', CAST(length(prompt) % 3 AS VARCHAR)) AS generated,
             [(length(prompt) % 5) / 2.0, (length(prompt) % 7) / 3.0, (length(prompt) % 11) / 4.0] AS logits FROM pr),
e AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM g),
preds AS (SELECT dataset, 'prompted' AS experiment, row_id, label, {sql_extract('generated', 2)} AS pred,
                 list_transform(ex, lambda x: x / list_sum(ex))[1:2] AS probs FROM e),
{class_stats_cte('preds')},
summ AS (SELECT {K}, sum(tp) / sum(support) AS accuracy, avg({ratio('2 * tp', 'support + predicted')}) AS macro_f1
         FROM stats GROUP BY ALL),
{curve_cte('preds', '1')},
{AUC_CTE},
{ece_cte('preds', 'list_max(probs)', HIT)}
SELECT s.dataset, s.experiment, round(s.accuracy, 6) AS accuracy, round(s.macro_f1, 6) AS macro_f1,
       round(a.auc, 6) AS roc_auc, round(e.ece, 6) AS ece
FROM summ s LEFT JOIN auc a USING ({K}) LEFT JOIN ece e USING ({K})""")


POSTS = f"""posts AS (
  SELECT doc_id AS row_id,
         concat(text, ' &amp; ', [{', '.join(q(x) for x in X.SYMBOLS)}][1 + doc_id % {len(X.SYMBOLS)}], ' http://', source, '/',
                doc_id, ' @', lang, ' me@ex.com at ', doc_id % 24, ':', lpad((doc_id % 60)::VARCHAR, 2, '0'), ' for $', doc_id, '.99 ',
                [{', '.join(q(x) for x in X.MARKS)}][1 + doc_id % {len(X.MARKS)}], ' #', regexp_extract(text, {q(X.FIRST_TWO)}, 1), regexp_extract(text, {q(X.FIRST_TWO)}, 2), ' #\u00d3dio!') AS text
  FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL)"""


def emoji_ctes(src: str) -> str:
    """``named`` (row_id, text, words, tokens) of ``src``: texts cut into symbol sequences and the rest, each
    distinct sequence named from its code points, texts joined again."""
    from ..functions import emoji as E
    values = ", ".join(f"({cp}, {q(n)})" for cp, n in sorted(E.emoji_names().items()))
    run = f":{T.NON_WS}+:"
    return f"""names(cp, name) AS (VALUES {values}),
ep AS (
  SELECT row_id, unnest(ps) AS piece, unnest(range(len(ps))) AS i
  FROM (SELECT row_id, regexp_extract_all(text, {q(E.piece_pattern())}) AS ps FROM {src} WHERE text IS NOT NULL)),
ec AS (
  SELECT piece, unnest(cs) AS ch, unnest(range(len(cs))) AS k
  FROM (SELECT piece, regexp_extract_all(piece, '(?s).') AS cs
        FROM (SELECT DISTINCT piece FROM ep WHERE regexp_full_match(piece, {q(E.sequence_pattern())})))),
said AS (
  SELECT piece, CASE
    WHEN regexp_full_match(piece, '[\\x{{1F1E6}}-\\x{{1F1FF}}]{{2}}')
      THEN concat('flag_', string_agg(CASE WHEN unicode(ch) BETWEEN 127462 AND 127487 THEN chr(97 + unicode(ch) - 127462) END, '' ORDER BY k))
    WHEN contains(piece, '\u20e3') THEN concat('keycap_', substr(piece, 1, 1))
    ELSE string_agg(n.name, '_' ORDER BY k) END AS name
  FROM ec LEFT JOIN names n ON n.cp = unicode(ec.ch) GROUP BY piece),
ej AS (
  SELECT row_id, string_agg(coalesce(':' || name || ':', ep.piece), '' ORDER BY i) AS marked,
         string_agg(coalesce(' ' || name || ' ', ep.piece), '' ORDER BY i) AS spaced
  FROM ep LEFT JOIN said ON said.piece = ep.piece GROUP BY row_id),
named AS (
  SELECT s.row_id, CASE WHEN s.text IS NOT NULL THEN array_to_string(list_transform(
           regexp_extract_all(coalesce(marked, ''), {q(run + '|(?s).')}),
           lambda p: CASE WHEN length(p) > 1 THEN replace(replace(replace(p, '_', ' '), '-', ' '), ':', '') ELSE p END), '') END AS words,
         CASE WHEN s.text IS NOT NULL THEN coalesce(spaced, '') END AS tokens
  FROM {src} s LEFT JOIN ej ON ej.row_id = s.row_id)"""


register("emoji_to_text", f"WITH {POSTS},\n{emoji_ctes('posts')}\nSELECT row_id, words AS out, tokens AS out_tokens FROM named")
register("generic_preprocess", f"WITH {POSTS},\n{emoji_ctes('posts')}\nSELECT row_id, {sql_generic('tokens')} AS out FROM named")


def segment_ctes(src: str, tag: str, foreign: bool = True) -> str:
    """``segmented`` (row_id, text) of ``src``: words and word pairs outside hashtags, a recursive search over the
    ends of each distinct cleaned tag that keeps the best split for every last word, the words read back from
    it, and each text rebuilt piece by piece."""
    kept = "" if foreign else "WHEN regexp_matches(ts.tag, '[^\\x00-\\x7f]') THEN substr(ts.tag, 2) "
    return f"""lists AS (
  SELECT regexp_extract_all(lower(regexp_replace(text, {q(tag)}, ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {src}),
bi AS (
  SELECT word, CASE WHEN regexp_full_match(follows, '[a-z0-9]+') THEN follows END AS follows, count(*) AS cnt
  FROM (SELECT unnest(w) AS word, unnest(list_append(w[2:], NULL)) AS follows FROM lists)
  WHERE regexp_full_match(word, '[a-z0-9]+') GROUP BY ALL),
u AS (SELECT word, sum(cnt)::BIGINT AS cnt FROM bi GROUP BY word),
tot AS (SELECT CAST(coalesce(sum(cnt), 1) AS DOUBLE) AS total FROM u),
tags AS (SELECT DISTINCT unnest(regexp_extract_all(text, {q(tag)})) AS tag FROM {src}
         WHERE contains(text, '#')),
ts AS (SELECT tag, regexp_replace(lower(tag), '[^a-z0-9]', '', 'g') AS s FROM tags),
cut AS (
  SELECT s, i, j, substr(s, i + 1, j - i) AS word
  FROM (SELECT DISTINCT s, unnest(range(0, length(s))) AS i FROM ts WHERE length(s) > 0) x, LATERAL (SELECT unnest(range(x.i + 1, length(x.s) + 1)) AS j) y),
sc AS (
  SELECT cut.*, u.cnt, CASE WHEN u.cnt IS NOT NULL THEN log10(u.cnt / total) ELSE 1.0::DOUBLE - log10(total) - (j - i) END AS alone
  FROM cut CROSS JOIN tot LEFT JOIN u ON u.word = cut.word),
pr AS (
  SELECT a.s, a.i AS h, b.i AS i, b.j AS j, log10(bi.cnt / a.cnt) AS cond
  FROM sc a JOIN sc b ON a.s = b.s AND a.j = b.i JOIN bi ON bi.word = a.word AND bi.follows = b.word WHERE a.cnt IS NOT NULL AND b.cnt IS NOT NULL),
dp(s, e, st) AS (
  SELECT DISTINCT s, 0, [struct_pack(i := -1, j := 0, v := 0.0::DOUBLE, h := -1)] FROM ts WHERE length(s) > 0
  UNION ALL
  SELECT q.s, any_value(q.e) + 1, list_concat(any_value(q.st), list(struct_pack(i := q.i, j := q.j, v := q.v, h := q.h)))
  FROM (
    SELECT dp.s, dp.e, dp.st, sc.i::INT AS i, sc.j::INT AS j, p.v + CASE WHEN pr.cond IS NOT NULL THEN pr.cond ELSE sc.alone END AS v, p.i::INT AS h,
           row_number() OVER (PARTITION BY dp.s, sc.i ORDER BY p.v + CASE WHEN pr.cond IS NOT NULL THEN pr.cond ELSE sc.alone END DESC, p.i) AS k
    FROM dp JOIN sc ON sc.s = dp.s AND sc.j = dp.e + 1, LATERAL (SELECT unnest(dp.st) AS p) x
    LEFT JOIN pr ON pr.s = dp.s AND pr.h = p.i AND pr.i = sc.i AND pr.j = sc.j
    WHERE p.j = sc.i) q
  WHERE q.k = 1 GROUP BY q.s),
bt(s, st, i, j, words) AS (
  SELECT s, st, l.i, l.j, []::VARCHAR[] FROM (
    SELECT s, st, list_sort(list_transform(list_filter(st, lambda x: x.j = length(s)), lambda x: struct_pack(v := -x.v, i := x.i, j := x.j)))[1] AS l
    FROM dp WHERE e = length(s))
  UNION ALL
  SELECT s, st, list_filter(st, lambda x: x.i = bt.i AND x.j = bt.j)[1].h, bt.i, list_prepend(substr(s, bt.i + 1, bt.j - bt.i), words)
  FROM bt WHERE j > 0),
seg AS (
  SELECT ts.tag, CASE {kept}WHEN true THEN coalesce(array_to_string(bt.words, ' '), '') END AS segmented
  FROM ts LEFT JOIN (SELECT s, words FROM bt WHERE j = 0) bt ON ts.s = bt.s),
pieces AS (
  SELECT row_id, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM (
    SELECT row_id, regexp_extract_all(text, {q(tag + '|[^#]+|#')}) AS p FROM {src}
    WHERE contains(text, '#'))),
rebuilt AS (
  SELECT row_id, string_agg(coalesce(seg.segmented, pieces.piece), '' ORDER BY pos) AS new_text
  FROM pieces LEFT JOIN seg ON pieces.piece = seg.tag GROUP BY row_id),
segmented AS (
  SELECT d.row_id, coalesce(r.new_text, d.text) AS text
  FROM {src} d LEFT JOIN rebuilt r ON d.row_id = r.row_id)"""


# Fixed value: a hashtag of the social cleaner.
TAG_WORD = "#[\\p{L}\\p{N}_]+"
register("segment_hashtags", f"WITH RECURSIVE {POSTS},\n{segment_ctes('posts', '#' + T.NON_WS + '+')}\nSELECT row_id, text FROM segmented")
register("social_normalize", f"""WITH RECURSIVE {POSTS},
tagged AS (SELECT row_id, {sql_social_tags('text')} AS text FROM posts),
{segment_ctes('tagged', TAG_WORD, foreign=False)}
SELECT row_id, {sql_social_tokens('text')} AS out FROM segmented""")
register("baseline_preprocess", f"""WITH RECURSIVE {POSTS},
{emoji_ctes('posts')},
tagged AS (SELECT row_id, {sql_social_tags(sql_ascii('words'))} AS text FROM named),
{segment_ctes('tagged', TAG_WORD, foreign=False)}
SELECT row_id, {sql_social_tokens('text')} AS out FROM segmented""")
