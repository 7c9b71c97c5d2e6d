"""The registered queries in plain SQL, written independently of the Spark code.

Each query is a chain of common table expressions over the given tables; ``NEEDS`` names what a
table builds on, so that a query only carries the expressions it uses.
"""

from examlake.fixed_values import (
    ACCENTED,
    DISPLAY_BANDS,
    INCOME_CLASS_BY_LETTER,
    INCOME_CLASS_ORDER,
    MEAN_BANDS,
    PRESENCE,
    RACE_LABELS,
    REPORT_LABELS,
    SCORES,
    SUBJECT_LABELS,
    SUBJECT_SLUGS,
    TABLE_SCORE_HEADERS,
    UF_BY_CODE,
    UNACCENTED,
    WAGE_RANGE_BY_LETTER,
)
from examlake.functions.text import fold_text, slug_text
from examlake.plans.exam_view import EXAM_COLUMNS, ROW_KEY
from examlake.plans.queries import (
    DEFAULT_YEAR,
    FIRST,
    LAST,
    METRIC,
    OTHER_TOWN,
    RACE_STATE,
    STATE,
    SUBJECT,
    TOWN,
    YEAR,
)


def q(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def case(column: str, mapping: dict, other: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k if isinstance(k, int) else q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {other} END"


def fold(c: str) -> str:
    return f"translate(upper({c}), '{ACCENTED}', '{UNACCENTED}')"


def title(c: str) -> str:
    runs = rf"regexp_extract_all(lower({c}), '(\p{{L}}+|[^\p{{L}}]+)')"
    return f"array_to_string(list_transform({runs}, lambda s: upper(s[1]) || s[2:]), '')"


def r4(expr: str, name: str) -> str:
    return f"round({expr}, 4) AS {name}"


def cols(names, prefix="") -> str:
    return ", ".join(f"{prefix}{n}" for n in names)


KEY = cols(ROW_KEY)
VALID = {s: f"CASE WHEN {s} BETWEEN 0 AND 1000 THEN {s} END" for s in SCORES}
R4_SCORES = ", ".join(r4(s, s) for s in SCORES)
PLAIN = [c for c in EXAM_COLUMNS if c not in SCORES]
BAD = "coalesce(NU_IDADE < 8 OR NU_IDADE > 120, false) OR " + " OR ".join(
    f"coalesce({s} < 0 OR {s} > 1000, false)" for s in SCORES
)
FIVE_MEAN = f"({' + '.join(SCORES)}) / 5"


def row_mean(names) -> str:
    total = " + ".join(f"coalesce({n}, 0)" for n in names)
    present = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in names)
    return f"(({total}) / nullif({present}, 0))"


def unpivot(table: str, keys: list[str], names, key_name: str, value_name: str, rename=None) -> str:
    lead = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(
        f"SELECT {lead}{q((rename or {}).get(n, n))} AS {key_name}, {n} AS {value_name} FROM {table}" for n in names
    )


def silver(year: str) -> str:
    return f"""
SELECT ID_INSCRICAO, {year} AS ANO,
  SG_UF_PROVA, CAST(CO_MUNICIPIO_PROVA AS VARCHAR) AS CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA, TP_SEXO,
  CAST(TP_COR_RACA AS BIGINT) AS TP_COR_RACA, CAST(NULL AS BIGINT) AS TP_FAIXA_ETARIA,
  CASE WHEN NU_IDADE BETWEEN 8 AND 120 THEN CAST(NU_IDADE AS BIGINT) END AS NU_IDADE, Q006,
  {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in
             ("TP_PRESENCA_CN", "TP_PRESENCA_CH", "TP_PRESENCA_LC", "TP_PRESENCA_MT", "TP_STATUS_REDACAO"))},
  {", ".join(f"{VALID[s]} AS {s}" for s in SCORES)}, {KEY}
FROM exam"""


CTE = {
    "exam": f"""
SELECT concat(l_orderkey, '-', l_linenumber) AS ID_INSCRICAO,
  CAST(year(l_shipdate) AS INTEGER) AS ANO,
  {case("10 + s_nationkey", UF_BY_CODE)} AS SG_UF_PROVA,
  CAST(10 + s_nationkey AS BIGINT) * 100000 + l_suppkey AS CO_MUNICIPIO_PROVA,
  CASE WHEN l_linenumber <= 4 THEN 'São Tomé d''Oeste ' ELSE 'Sao Tome d''Oeste ' END || l_suppkey
    AS NO_MUNICIPIO_PROVA,
  CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS TP_SEXO,
  CASE WHEN l_partkey % 50 <> 0 THEN l_linenumber - 1 END AS TP_COR_RACA,
  CAST(l_quantity + 5 AS INTEGER) AS NU_IDADE,
  substring('ABCDEFGHIJKLMNOPQRST', CAST(l_partkey % 20 AS INTEGER) + 1, 1) AS Q006,
  substring('ABCZ', CAST(l_partkey % 4 AS INTEGER) + 1, 1) AS RENDA_FAMILIAR,
  CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE 1 END AS TP_PRESENCA_CN,
  CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 1 END AS TP_PRESENCA_CH,
  CASE WHEN l_partkey % 17 = 0 THEN 0 ELSE 1 END AS TP_PRESENCA_LC,
  CASE WHEN l_partkey % 19 = 0 THEN 0 ELSE 1 END AS TP_PRESENCA_MT,
  CASE WHEN l_suppkey % 9 = 0 THEN 4 ELSE 1 END AS TP_STATUS_REDACAO,
  l_extendedprice / CAST(99.7 AS DOUBLE) AS NOTA_CIENCIAS_NATUREZA,
  l_quantity * 20 AS NOTA_CIENCIAS_HUMANAS,
  CASE WHEN l_partkey % 23 <> 0 THEN round(l_discount * 10000, 2) END AS NOTA_LINGUAGENS_CODIGOS,
  o_totalprice / CAST(499.3 AS DOUBLE) AS NOTA_MATEMATICA,
  round(l_tax * 10000, 2) AS NOTA_REDACAO,
  {KEY}
FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    # Standardised rows: the text layout drops the year of every 29th part and out-of-range values.
    "silver": silver(f"CASE WHEN l_partkey % 29 = 0 THEN {DEFAULT_YEAR} ELSE ANO END"),
    # The same rows out of files by year, whose year they take.
    "filed": silver("ANO"),
    "numbered": f"""
SELECT *, row_number() OVER (PARTITION BY ANO, ID_INSCRICAO ORDER BY {KEY}) AS nth
FROM exam WHERE NOT ({BAD})""",
    "kept": f"""
SELECT * REPLACE (
  CASE WHEN RENDA_FAMILIAR IN ('A', 'B', 'C') THEN RENDA_FAMILIAR ELSE 'UNKNOWN' END AS RENDA_FAMILIAR,
  CASE WHEN TP_COR_RACA BETWEEN 0 AND 5 THEN TP_COR_RACA END AS TP_COR_RACA)
FROM numbered WHERE nth = 1""",
    "classed": f"""
SELECT *,
  CASE WHEN NU_IDADE <= 17 THEN 'ATE_17' WHEN NU_IDADE <= 24 THEN '18_A_24'
       WHEN NU_IDADE <= 34 THEN '25_A_34' WHEN NU_IDADE <= 200 THEN '35_MAIS' END AS CLASS_FAIXA_ETARIA,
  CASE WHEN {row_mean(SCORES)} IS NULL THEN 'NA' WHEN {row_mean(SCORES)} >= 650 THEN 'ALTA'
       WHEN {row_mean(SCORES)} >= 550 THEN 'MEDIA' ELSE 'BAIXA' END AS CLASS_NOTA_GLOBAL,
  CASE WHEN RENDA_FAMILIAR IN ('A', 'B', 'C') THEN RENDA_FAMILIAR ELSE 'UNKNOWN' END AS CLASS_RENDA_FAMILIAR
FROM exam""",
    "stats": f"""
SELECT ANO, count(DISTINCT ID_INSCRICAO) AS TOTAL_INSCRITOS,
  avg(age) AS IDADE_mean, stddev_samp(age) AS IDADE_std, min(age) AS IDADE_min, median(age) AS IDADE_median,
  max(age) AS IDADE_max,
  {", ".join(f'''count({s}) AS {s}_count, coalesce(avg({s}), 0) AS {s}_mean,
  coalesce(stddev_samp({s}), 0) AS {s}_std, coalesce(min({s}), 0) AS {s}_min,
  coalesce(median({s}), 0) AS {s}_median, coalesce(max({s}), 0) AS {s}_max''' for s in SCORES)}
FROM (SELECT ANO, ID_INSCRICAO, CAST(CASE WHEN NU_IDADE BETWEEN 8 AND 120 THEN NU_IDADE END AS DOUBLE) AS age,
        {", ".join(f"{VALID[s]} AS {s}" for s in SCORES)} FROM exam)
GROUP BY ANO""",
    "geo": f"""
SELECT ANO, SG_UF_PROVA, CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA, count(DISTINCT ID_INSCRICAO) AS INSCRITOS,
  {", ".join(f"count({s}) AS {s}_count, avg({s}) AS {s}_mean" for s in SCORES)}
FROM (SELECT ANO, SG_UF_PROVA, CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA, ID_INSCRICAO,
        {", ".join(f"CASE WHEN {PRESENCE[s]} = 1 THEN {VALID[s]} END AS {s}" for s in SCORES)} FROM exam
      WHERE SG_UF_PROVA IS NOT NULL AND CO_MUNICIPIO_PROVA IS NOT NULL AND NO_MUNICIPIO_PROVA IS NOT NULL)
GROUP BY ALL""",
    "geo_uf": f"""
SELECT ANO, SG_UF_PROVA, count(DISTINCT ID_INSCRICAO) AS INSCRITOS,
  {", ".join(f"count({VALID[s]}) AS {s}_count, avg({VALID[s]}) AS {s}_mean" for s in SCORES)}
FROM exam WHERE SG_UF_PROVA IS NOT NULL GROUP BY ANO, SG_UF_PROVA""",
    "scores_long": unpivot("exam", ["ANO"], SCORES, "DISCIPLINA", "value"),
    "hist": """
SELECT s.ANO, s.DISCIPLINA, CAST(b AS DOUBLE) * 20 AS BIN_START, CAST(b AS DOUBLE) * 20 + 20 AS BIN_END,
  count(l.value) AS CONTAGEM
FROM (SELECT DISTINCT ANO, DISCIPLINA FROM scores_long WHERE value BETWEEN 0 AND 1000) s
CROSS JOIN range(0, 50) t(b)
LEFT JOIN scores_long l ON l.ANO = s.ANO AND l.DISCIPLINA = s.DISCIPLINA AND l.value BETWEEN 0 AND 1000
  AND l.value >= b * 20 AND (l.value < b * 20 + 20 OR (b = 49 AND l.value = 1000))
GROUP BY ALL""",
    "box": f"""
SELECT {case("Q006", INCOME_CLASS_BY_LETTER)} AS CLASSE, min(score) AS LOW, quantile_cont(score, 0.25) AS Q1,
  quantile_cont(score, 0.5) AS MEDIAN, quantile_cont(score, 0.75) AS Q3, max(score) AS HIGH,
  count(score) AS COUNT, ANO
FROM (SELECT ANO, Q006, {row_mean(SCORES)} AS score FROM exam
      WHERE TP_PRESENCA_CN = 1 AND TP_PRESENCA_CH = 1 AND TP_PRESENCA_LC = 1 AND TP_PRESENCA_MT = 1
        AND TP_STATUS_REDACAO = 1)
WHERE {case("Q006", INCOME_CLASS_BY_LETTER)} IS NOT NULL GROUP BY ALL""",
    "mean5": f"""
SELECT *, round_even({FIVE_MEAN} * 100, 0) / 100 AS MEDIA_5_DISC FROM exam
WHERE {" AND ".join(f"{s} BETWEEN 0 AND 1000" for s in SCORES)}""",
    "bands": f"""
SELECT ANO, coalesce(SG_UF_PROVA, 'XX') AS SG_UF_PROVA, ID_FAIXA,
  {case("ID_FAIXA", {b[0]: b[3] for b in MEAN_BANDS})} AS DESCRICAO_FAIXA, count(*) AS QTD_ALUNOS
FROM (SELECT *, CASE WHEN MEDIA_5_DISC < 400 THEN 1 WHEN MEDIA_5_DISC < 600 THEN 2
                     WHEN MEDIA_5_DISC < 800 THEN 3 ELSE 4 END AS ID_FAIXA FROM mean5)
GROUP BY ALL""",
    "dim": f"""
SELECT CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA,
  {case("CAST(substring(CAST(CO_MUNICIPIO_PROVA AS VARCHAR), 1, 2) AS INTEGER)", UF_BY_CODE)} AS SG_UF_PROVA
FROM (SELECT *, row_number() OVER (PARTITION BY CO_MUNICIPIO_PROVA ORDER BY n DESC, NO_MUNICIPIO_PROVA) AS rn
      FROM (SELECT CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA, count(*) AS n FROM exam
            WHERE CO_MUNICIPIO_PROVA IS NOT NULL AND NO_MUNICIPIO_PROVA IS NOT NULL GROUP BY ALL))
WHERE rn = 1""",
    "race": f"""
SELECT ANO, {case("TP_COR_RACA", RACE_LABELS, q("Não Disp."))} AS RACA,
  {", ".join(f"avg({s}) AS {s}" for s in SUBJECT_LABELS)}, count(*) AS COUNT
FROM exam GROUP BY ANO, TP_COR_RACA HAVING count(*) > 100""",
    "race_year": f"""
SELECT {case("TP_COR_RACA", RACE_LABELS, q("Não Disp."))} AS RACA,
  {", ".join(f"avg({s}) AS {s}" for s in SUBJECT_LABELS)}, count(*) AS COUNT
FROM exam WHERE ANO = {YEAR} GROUP BY TP_COR_RACA HAVING count(*) > 100""",
    "evolution_rows": f"""
SELECT *, {title("NO_MUNICIPIO_PROVA")} AS display, {fold(title("NO_MUNICIPIO_PROVA"))} AS k,
  ({" + ".join(f"coalesce({s}_mean, 0)" for s in SCORES)}) / 5 AS MEDIA_FINAL
FROM geo WHERE SG_UF_PROVA = {q(STATE)} AND NOTA_REDACAO_count >= 1""",
}
NEEDS = {
    "silver": ["exam"],
    "filed": ["exam"],
    "numbered": ["exam"],
    "kept": ["numbered"],
    "classed": ["exam"],
    "stats": ["exam"],
    "geo": ["exam"],
    "geo_uf": ["exam"],
    "scores_long": ["exam"],
    "hist": ["scores_long"],
    "box": ["exam"],
    "mean5": ["exam"],
    "bands": ["mean5"],
    "dim": ["exam"],
    "race": ["exam"],
    "race_year": ["exam"],
    "evolution_rows": ["geo"],
}


def needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in [*needed(NEEDS.get(name, [])), name]:
            if n not in out:
                out.append(n)
    return out


def over(tables: str, body: str) -> str:
    chain = needed(tables.split())
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in chain) + "\n" + body


EXAM_OUT = f"{cols(PLAIN)}, {R4_SCORES}"
GEO_MEASURES = ", ".join(f"{s}_count, {r4(f'{s}_mean', f'{s}_mean')}" for s in SCORES)
GEO_OUT = f"ANO, SG_UF_PROVA, CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA, INSCRITOS, {GEO_MEASURES}"
PAGE_OUT = (
    "ANO, SG_UF_PROVA, CAST(CO_MUNICIPIO_PROVA AS VARCHAR) AS CO_MUNICIPIO_PROVA, "
    f"{title('NO_MUNICIPIO_PROVA')} AS NO_MUNICIPIO_PROVA, INSCRITOS, {GEO_MEASURES}"
)
UF_OUT = f"ANO, SG_UF_PROVA, INSCRITOS, {GEO_MEASURES}"
STAT_NAMES = ("mean", "std", "min", "median", "max")
STATS_OUT = "ANO, TOTAL_INSCRITOS, " + ", ".join(
    [r4(f"IDADE_{x}", f"IDADE_{x}") for x in STAT_NAMES]
    + [f"{s}_count, " + ", ".join(r4(f"{s}_{x}", f"{s}_{x}") for x in STAT_NAMES) for s in SCORES]
)
BOX_MEASURES = ", ".join(r4(x, x) for x in ("LOW", "Q1", "MEDIAN", "Q3", "HIGH"))
RACE_OUT = "RACA, " + ", ".join(r4(s, s) for s in SUBJECT_LABELS) + ", COUNT"
CLASS_COLUMNS = "CLASS_FAIXA_ETARIA, CLASS_NOTA_GLOBAL, CLASS_RENDA_FAMILIAR"
CLASS_ROWS = over("classed", f"SELECT ID_INSCRICAO, ANO, NU_IDADE, {R4_SCORES}, {CLASS_COLUMNS} FROM classed")


def min_counts(n: int) -> str:
    return " AND ".join(f"{s}_count >= {n}" for s in SCORES)


def class_summary(where: str) -> str:
    counts = unpivot(
        f"(SELECT * FROM classed WHERE {where})", [], CLASS_COLUMNS.split(", "), "class_name", "class_value"
    )
    ages = " UNION ALL ".join(
        f"SELECT 'CLASS_FAIXA_ETARIA', '{a}', 0" for a in ("ATE_17", "18_A_24", "25_A_34", "35_MAIS")
    )
    return over(
        "classed",
        f"""SELECT class_name, class_value, CAST(sum(n) AS BIGINT) AS total FROM (
SELECT class_name, coalesce(class_value, 'nan') AS class_value, count(*) AS n FROM ({counts}) GROUP BY ALL
UNION ALL {ages}) GROUP BY ALL""",
    )


CLEAN_VALID = over("kept", f"SELECT {EXAM_OUT} FROM kept")
CLEAN_REPORT = over(
    "numbered",
    f"""SELECT ANO, rule, CAST(sum(n) AS BIGINT) AS affected_rows FROM (
SELECT ANO, 'invalid_rows' AS rule, 1 AS n FROM exam WHERE {BAD}
UNION ALL SELECT ANO, 'duplicates', 1 FROM numbered WHERE nth > 1
UNION ALL SELECT ANO, 'domain:RENDA_FAMILIAR', 1 FROM numbered WHERE nth = 1 AND RENDA_FAMILIAR NOT IN ('A', 'B', 'C')
UNION ALL SELECT ANO, 'domain:TP_COR_RACA', 1 FROM numbered WHERE nth = 1 AND TP_COR_RACA NOT BETWEEN 0 AND 5
) GROUP BY ALL""",
)
REASON = (
    "CASE WHEN NU_IDADE < 8 OR NU_IDADE > 120 THEN 'range_NU_IDADE' "
    + " ".join(f"WHEN {s} < 0 OR {s} > 1000 THEN 'range_{s}'" for s in SCORES)
    + " END"
)
SILVER_OUT = f"""ID_INSCRICAO, CAST(ANO AS INTEGER) AS ANO, SG_UF_PROVA, CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA,
TP_SEXO, TP_COR_RACA, TP_FAIXA_ETARIA, NU_IDADE, Q006, TP_PRESENCA_CN, TP_PRESENCA_CH, TP_PRESENCA_LC,
TP_PRESENCA_MT, TP_STATUS_REDACAO, {R4_SCORES}"""
STD_TYPED = over("silver", f"SELECT {SILVER_OUT} FROM silver")


def dedup(nth: str) -> str:
    return over(
        "exam",
        f"""SELECT {EXAM_OUT} FROM (SELECT *, row_number() OVER (
PARTITION BY TP_COR_RACA, CO_MUNICIPIO_PROVA ORDER BY {KEY}) AS nth FROM exam) WHERE nth {nth}""",
    )


def domains() -> str:
    names = ["TP_SEXO", "Q006", "RENDA_FAMILIAR", "NO_MUNICIPIO_PROVA", "TP_COR_RACA"]
    parts = []
    for n in names:
        parts.append(f"""SELECT '{n}' AS "column",
  CASE WHEN count(*) > 20 THEN '' ELSE string_agg(v, ',' ORDER BY first_at) END AS domain, count(*) > 20 AS too_many
FROM (SELECT v, min(seen_at) AS first_at FROM (SELECT CAST({n} AS VARCHAR) AS v,
        row_number() OVER (ORDER BY {KEY}) AS seen_at FROM exam) WHERE v IS NOT NULL GROUP BY v)""")
    return over("exam", " UNION ALL ".join(parts))


def race_history() -> str:
    used = [s for s in SUBJECT_SLUGS]
    valid = [s if s == "NOTA_REDACAO" else f"nullif({s}, 0)" for s in used]
    picks = []
    for label in dict.fromkeys(RACE_LABELS.values()):
        mine = f"RACA = {q(label)}"
        slug = slug_text(label)
        pick = lambda e: f"max({e}) FILTER ({mine})"
        picks.append(f'{pick("value")} AS "{slug}_value"')
        picks.append(f'{pick("COUNT")} AS "{slug}_count"')
        picks.append(f'CAST({pick("used")} AS INTEGER) AS "{slug}_discipline_count"')
        picks += [f'{pick(f"{n}_text")} AS "{slug}_{n}"' for n in SUBJECT_SLUGS.values()]
    present = " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 END" for v in valid)
    texts = ", ".join(f"coalesce(printf('%.1f', round({s}, 1)), 's/d') AS {n}_text" for s, n in SUBJECT_SLUGS.items())
    return over(
        "race",
        f"""SELECT CAST(y AS VARCHAR) AS year, {", ".join(picks)}
FROM range({FIRST}, 2004) t(y) LEFT JOIN (
  SELECT *, round(coalesce({row_mean(valid)}, 0), 1) AS value, {present} AS used, {texts},
    row_number() OVER (PARTITION BY ANO, RACA ORDER BY COUNT) AS last
  FROM race) r ON r.ANO = y AND last = 1
GROUP BY y""",
    )


def band_shares(source: str, tables: str) -> str:
    spine = " UNION ALL ".join(f"SELECT {q(b)} AS FAIXA" for b in DISPLAY_BANDS)
    return over(
        tables,
        f"""SELECT f.FAIXA, CAST(coalesce(n, 0) AS BIGINT) AS QTD_ALUNOS,
  CASE WHEN total > 0 THEN round_even(coalesce(n, 0) / total * 100 * 100, 0) / 100 ELSE 0 END AS PERCENTUAL
FROM ({spine}) f LEFT JOIN ({source}) c ON c.FAIXA = f.FAIXA
CROSS JOIN (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS total FROM ({source}))""",
    )


def checks() -> str:
    rows = [
        ("tb_notas_stats", "row_count > 0", "count(*)", "> 0", "stats"),
        ("tb_notas_stats", "missing_count(ANO) = 0", "count(*) FILTER (ANO IS NULL)", "= 0", "stats"),
        ("tb_notas_stats", "min(NOTA_MATEMATICA_mean) >= 0", "min(NOTA_MATEMATICA_mean)", ">= 0", "stats"),
        ("tb_notas_stats", "max(NOTA_MATEMATICA_mean) <= 1000", "max(NOTA_MATEMATICA_mean)", "<= 1000", "stats"),
        ("tb_notas_geo_uf", "row_count > 0", "count(*)", "> 0", "geo_uf"),
        ("tb_notas_geo_uf", "missing_count(SG_UF_PROVA) = 0", "count(*) FILTER (SG_UF_PROVA IS NULL)", "= 0", "geo_uf"),
        ("tb_notas_geo_uf", "duplicate_count(ANO, SG_UF_PROVA) = 0",
         "count(*)", "= 0", "(SELECT 1 FROM geo_uf GROUP BY ANO, SG_UF_PROVA HAVING count(*) > 1)"),
        ("tb_socio_economico", "row_count > 0", "count(*)", "> 0", "box"),
        ("tb_socio_economico", "missing_count(CLASSE) = 0", "count(*) FILTER (CLASSE IS NULL)", "= 0", "box"),
        ("tb_socio_economico", "min(LOW) >= 0", "min(LOW)", ">= 0", "box"),
        ("tb_socio_economico", "max(HIGH) <= 1000", "max(HIGH)", "<= 1000", "box"),
    ]
    return over(
        "stats geo_uf box",
        " UNION ALL ".join(
            f"SELECT {q(t)} AS table_name, {q(c)} AS check_name, round(CAST({v} AS DOUBLE), 4) AS value, "
            f"coalesce({v} {cond}, false) AS passed FROM {src}"
            for t, c, v, cond, src in rows
        ),
    )


def radar(state: str | None) -> str:
    def one(source: str, where: str, agg: str) -> str:
        picked = f"(SELECT {{0}} FROM {source} WHERE {where})"
        return picked.replace("{0}", f"{agg}({{m}})")

    br = one("stats", f"ANO = {YEAR}", "max")
    uf = one("geo_uf", f"ANO = {YEAR} AND SG_UF_PROVA = {q(state)}" if state else "false", "max")
    best = one("geo_uf", f"ANO = {YEAR}", "max")
    return over(
        "stats geo_uf",
        " UNION ALL ".join(
            "SELECT "
            + f"{q(label)} AS metric, "
            + ", ".join(
                r4(e.replace("{m}", f"{s}_mean"), n)
                for e, n in ((br, "br_mean"), (uf, "uf_mean"), (best, "best_uf_mean"))
            )
            + ", 1000 AS full_mark"
            for s, label in SUBJECT_LABELS.items()
        ),
    )


SHARES_TOWN = f"""SELECT CASE WHEN m < 400 THEN 'Abaixo de 400' WHEN m < 600 THEN '400 a 600'
  WHEN m < 800 THEN '600 a 800' ELSE 'Acima de 800' END AS FAIXA, count(*) AS n
FROM (SELECT {FIVE_MEAN} AS m FROM exam WHERE SG_UF_PROVA = {q(STATE)}
      AND {fold("NO_MUNICIPIO_PROVA")} = {q(fold_text(TOWN))}) WHERE m IS NOT NULL GROUP BY ALL"""
SHARES_STATE = f"""SELECT {case("ID_FAIXA", dict(zip([b[0] for b in MEAN_BANDS], DISPLAY_BANDS)))} AS FAIXA,
  CAST(sum(QTD_ALUNOS) AS BIGINT) AS n FROM bands WHERE SG_UF_PROVA = {q(STATE)} AND ANO = {YEAR} GROUP BY ALL"""

EVOLUTION = {
    "MEDIA_CN": "NOTA_CIENCIAS_NATUREZA_mean",
    "MEDIA_CH": "NOTA_CIENCIAS_HUMANAS_mean",
    "MEDIA_LC": "NOTA_LINGUAGENS_CODIGOS_mean",
    "MEDIA_MT": "NOTA_MATEMATICA_mean",
    "MEDIA_RED": "NOTA_REDACAO_mean",
    "MEDIA_FINAL": "MEDIA_FINAL",
}


def evolution(where: str) -> str:
    """Evolution rows: shown name, first row per name and year."""
    return f"""(SELECT *, first_value(display) OVER (PARTITION BY k
    ORDER BY CASE WHEN regexp_full_match(display, '[\\x00-\\x7F]*') THEN 1 ELSE 0 END, ANO, NO_MUNICIPIO_PROVA,
      CO_MUNICIPIO_PROVA) AS shown,
  row_number() OVER (PARTITION BY k, ANO ORDER BY NO_MUNICIPIO_PROVA, CO_MUNICIPIO_PROVA) AS nth
FROM evolution_rows WHERE {where})"""


def town_names(source: str, where: str) -> str:
    return over(
        source,
        f"""SELECT d AS NO_MUNICIPIO_PROVA FROM (SELECT d, row_number() OVER (PARTITION BY {fold("d")}
  ORDER BY CASE WHEN regexp_full_match(d, '[\\x00-\\x7F]*') THEN 1 ELSE 0 END, raw) AS nth
FROM (SELECT DISTINCT NO_MUNICIPIO_PROVA AS raw, {title("NO_MUNICIPIO_PROVA")} AS d FROM {source} WHERE {where}))
WHERE nth = 1""",
    )


def weighted(metric: str, name: str) -> str:
    value = f"sum({metric} * INSCRITOS) / sum(CASE WHEN {metric} IS NOT NULL THEN INSCRITOS END)"
    return f"coalesce(round({value}, 1), 0) AS {name}"


def masked(c: str) -> str:
    return (
        f"CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) "
        f"ELSE substring({c}, 1, 2) || repeat('*', length({c}) - 4) || right({c}, 2) END"
    )


def labelled(source: str, where: str, heads: str) -> str:
    scores = ", ".join(
        f"""coalesce(printf('%.1f', round({c}, 1)), '') AS "{label}\"""" for c, label in TABLE_SCORE_HEADERS.items()
    )
    return over(source, f"SELECT {heads}, {scores} FROM {source} WHERE {where}")


PUBLISHED = {
    "silver_microdados": "raw",
    **{f"gold_{t}": "exam" for t in ("cleaned", "classes", "tb_notas")},
    "gold_tb_notas_stats": "stats",
    "gold_tb_notas_geo": "geo",
    "gold_tb_notas_geo_uf": "geo_uf",
    "gold_tb_notas_histogram": "hist",
    "gold_tb_socio_economico": "box",
    "gold_tb_media_uf": "bands",
    "dim_municipio": "(SELECT 1 FROM dim WHERE SG_UF_PROVA IS NOT NULL)",
}
_PLACE = [("ANO", "int"), ("SG_UF_PROVA", "string")]
_MEANS = [(f"{s}_{x}", t) for s in SCORES for x, t in (("count", "bigint"), ("mean", "double"))]
PUBLISHED_COLUMNS = {
    "gold_tb_notas_stats": [("ANO", "int"), ("TOTAL_INSCRITOS", "bigint"), *[(f"IDADE_{x}", "double") for x in STAT_NAMES]]
    + [c for s in SCORES for c in [(f"{s}_count", "bigint"), *[(f"{s}_{x}", "double") for x in STAT_NAMES]]],
    "gold_tb_notas_geo": [*_PLACE, ("CO_MUNICIPIO_PROVA", "bigint"), ("NO_MUNICIPIO_PROVA", "string"), ("INSCRITOS", "bigint"), *_MEANS],
    "gold_tb_notas_geo_uf": [*_PLACE, ("INSCRITOS", "bigint"), *_MEANS],
    "gold_tb_notas_histogram": [("ANO", "int"), ("DISCIPLINA", "string"), ("BIN_START", "double"), ("BIN_END", "double"), ("CONTAGEM", "bigint")],
}


def published(body: str) -> str:
    """Over the gold tables of the cleaned rows; ``raw`` are the rows before."""
    chain = [n for n in needed("kept stats geo geo_uf hist box bands dim".split()) if n not in ("exam", "numbered", "kept")]
    parts = [f"raw AS ({CTE['exam']})", f"numbered AS ({CTE['numbered'].replace('FROM exam', 'FROM raw')})", f"exam AS ({CTE['kept']})"]
    return "WITH " + ",\n".join([*parts, *[f"{n} AS ({CTE[n]})" for n in chain]]) + "\n" + body


def oracle_sql() -> dict[str, str]:
    report_scores = ", ".join(
        f'round_even(coalesce({c}, 0) * 10, 0) / 10 AS "{label}"'
        for c, label in REPORT_LABELS.items()
        if c.endswith("_mean")
    )
    ordinal = " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(INCOME_CLASS_ORDER))
    uf_means = ", ".join(r4(f"avg({s}_mean)", f"{s}_mean") for s in SCORES)
    series = unpivot(
        "(SELECT ANO, NOTA_CIENCIAS_NATUREZA_mean AS MEDIA_CN, NOTA_CIENCIAS_HUMANAS_mean AS MEDIA_CH, "
        "NOTA_LINGUAGENS_CODIGOS_mean AS MEDIA_LC, NOTA_MATEMATICA_mean AS MEDIA_MT, NOTA_REDACAO_mean AS MEDIA_RED, "
        "MEDIA_FINAL, CAST(INSCRITOS AS DOUBLE) AS QTD_ALUNOS FROM "
        + evolution(f"{fold('NO_MUNICIPIO_PROVA')} = {q(fold_text(TOWN))}")
        + " WHERE nth = 1)",
        ["ANO"],
        [*EVOLUTION, "QTD_ALUNOS"],
        "series",
        "value",
    )
    audit_names = ", ".join(q(c) for c in EXAM_COLUMNS)
    untracked = sorted(c for c in EXAM_COLUMNS if c not in ("ID_INSCRICAO", "ANO", *SCORES))
    kpi = " + ".join(f"round(coalesce({s}_mean, 0), 1)" for s in SCORES)
    town_rows = over(
        "geo",
        f"""SELECT ANO, SG_UF_PROVA, CAST(CO_MUNICIPIO_PROVA AS VARCHAR) AS CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA,
INSCRITOS, {GEO_MEASURES} FROM geo WHERE {min_counts(1)}""",
    )
    # table -> (source, number of columns, has a year)
    gold = {
        "tb_notas": ("exam", 10, True),
        "tb_notas_stats": ("stats", 37, True),
        "tb_notas_geo": ("geo", 15, True),
        "tb_notas_geo_uf": ("geo_uf", 13, True),
        "tb_notas_histogram": ("hist", 5, True),
        "tb_socio_economico": ("box", 8, True),
        "tb_media_uf": ("bands", 5, True),
        "dim_municipio": ("(SELECT 1 FROM dim WHERE SG_UF_PROVA IS NOT NULL)", 3, False),
    }
    out = {
        "audit_gold": over(
            "exam stats geo geo_uf hist box bands dim",
            " UNION ALL ".join(
                f"SELECT 'gold' AS layer, '{t}' AS parquet_path, count(*) AS row_count, {n} AS column_count, "
                f"{str(year).lower()} AS has_ano_column FROM {src}"
                for t, (src, n, year) in gold.items()
            ),
        ),
        "json_export": town_rows,
        "csv_export": town_rows,
        "lake_round_trip": over(
            "exam",
            f"""SELECT ANO, SG_UF_PROVA, count(*) AS n, {r4(f"avg({SUBJECT})", "mean")}
FROM (SELECT ANO, SG_UF_PROVA, {SUBJECT} FROM exam WHERE ANO IN ({FIRST}, {YEAR})
      UNION ALL SELECT ANO, SG_UF_PROVA, {SUBJECT} FROM exam WHERE ANO = {YEAR}) GROUP BY ANO, SG_UF_PROVA""",
        ),
        "std_typed": STD_TYPED,
        "csv_round_trip": STD_TYPED,
        "stream_standardize": STD_TYPED,
        "gold_normalized": over(
            "exam",
            f"""SELECT ANO, ID_INSCRICAO, TP_SEXO, CASE WHEN NU_IDADE BETWEEN 8 AND 120 THEN NU_IDADE END AS NU_IDADE,
{r4("NOTA_CIENCIAS_NATUREZA", "NOTA_CIENCIAS_NATUREZA")}, CAST(NULL AS DOUBLE) AS NOTA_CIENCIAS_HUMANAS,
CAST(NULL AS DOUBLE) AS NOTA_LINGUAGENS_CODIGOS, {r4("NOTA_MATEMATICA", "NOTA_MATEMATICA")},
CAST(NULL AS DOUBLE) AS NOTA_REDACAO FROM exam""",
        ),
        "unified_scores": over(
            "exam",
            f"""SELECT ANO, ID_INSCRICAO, TP_SEXO, TP_COR_RACA,
CASE WHEN NU_IDADE BETWEEN 8 AND 120 THEN NU_IDADE END AS NU_IDADE, {R4_SCORES} FROM exam WHERE ANO >= {YEAR}
UNION ALL SELECT ANO, ID_INSCRICAO, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(trunc(NOTA_REDACAO) AS DOUBLE)
FROM exam WHERE ANO < {YEAR}""",
        ),
        "small_domain": domains(),
        "contract_typed": over(
            "exam",
            f"""SELECT CASE WHEN l_partkey % 29 <> 0 THEN CAST(ANO AS BIGINT) END AS NU_ANO,
NO_MUNICIPIO_PROVA AS MUNICIPIO_PROVA, TP_COR_RACA || ',0' AS TP_ETNIA, CAST(NU_IDADE AS BIGINT) AS IDADE FROM exam""",
        ),
        "contract_from_metadata": over(
            "exam",
            f"""SELECT CASE WHEN l_partkey % 29 <> 0 THEN CAST(ANO AS BIGINT) END AS NU_ANO,
NO_MUNICIPIO_PROVA AS MUNICIPIO_PROVA, TP_COR_RACA || ',0' AS TP_ETNIA, CAST(NU_IDADE AS BIGINT) AS IDADE, '0,1,2,3,4,5' AS allowed
FROM exam WHERE ANO = {YEAR}""",
        ),
        "raw_layouts": over("filed", f"SELECT {SILVER_OUT} FROM filed WHERE ANO IN ({FIRST}, {YEAR})"),
        "lake_rebuild": over(
            "exam",
            f"""SELECT * FROM (
  WITH made AS (SELECT ANO, ID_INSCRICAO FROM exam WHERE ANO IN ({FIRST}, {LAST}) OR (ANO = {YEAR} AND TP_SEXO = 'F')),
  sums AS (SELECT ANO, count(*) AS n, count(DISTINCT ID_INSCRICAO) AS ids FROM made GROUP BY ANO)
  SELECT 'silver' AS dataset, ANO, n FROM sums UNION ALL SELECT 'cleaned', ANO, ids FROM sums UNION ALL SELECT 'classes', ANO, ids FROM sums
  UNION ALL SELECT 'cleaning_duplicates', ANO, n - ids FROM sums WHERE n > ids)""",
        ),
        "year_selection": over(
            "exam", f"SELECT ANO, count(*) AS n FROM exam WHERE ANO BETWEEN {FIRST} AND {LAST} GROUP BY ANO"
        ),
        "skip_existing": over(
            "exam",
            "SELECT CAST(y AS INTEGER) AS ANO FROM range(1990, 2010) t(y) WHERE y NOT IN (SELECT ANO FROM exam)",
        ),
        "clean_valid": CLEAN_VALID,
        "stream_clean": CLEAN_VALID,
        "clean_metadata": over(
            "numbered",
            f"""SELECT {EXAM_OUT} FROM (SELECT * REPLACE (
  CASE WHEN RENDA_FAMILIAR IN ('A', 'B') OR (ANO < {YEAR} AND RENDA_FAMILIAR = 'C') THEN RENDA_FAMILIAR ELSE 'UNKNOWN' END AS RENDA_FAMILIAR,
  CASE WHEN ANO % 2 <> 0 OR TP_COR_RACA BETWEEN 0 AND 5 THEN TP_COR_RACA END AS TP_COR_RACA) FROM numbered WHERE nth = 1)""",
        ),
        "clean_invalid": over("exam", f"SELECT {EXAM_OUT} FROM exam WHERE {BAD}"),
        "clean_duplicates": over("numbered", f"SELECT {EXAM_OUT} FROM numbered WHERE nth > 1"),
        "clean_report": CLEAN_REPORT,
        "stream_clean_report": CLEAN_REPORT,
        "rule_valid": over("exam", f"SELECT {EXAM_OUT} FROM exam WHERE NOT ({BAD})"),
        "rule_first_reason": over(
            "exam", f"SELECT {REASON} AS _reason, {EXAM_OUT} FROM exam WHERE {REASON} IS NOT NULL"
        ),
        "rule_report": over(
            "exam",
            f"""SELECT 'numeric_range' AS rule_type, substring(reason, 7) AS "column",
CASE WHEN reason = 'range_NU_IDADE' THEN 'Valores fora do range (8, 120)'
     ELSE 'Valores fora do range (0, 1000)' END AS issue, count(*) AS affected_rows
FROM (SELECT {REASON} AS reason FROM exam) WHERE reason IS NOT NULL GROUP BY ALL""",
        ),
        "domain_null_repair": over(
            "exam",
            """SELECT ID_INSCRICAO,
CASE WHEN SG_UF_PROVA IN ('PA', 'SP', 'RJ', 'BA') THEN SG_UF_PROVA ELSE 'UNKNOWN' END AS SG_UF_PROVA,
CASE WHEN RENDA_FAMILIAR IN ('A', 'B', 'C') THEN RENDA_FAMILIAR ELSE 'UNKNOWN' END AS RENDA_FAMILIAR FROM exam""",
        ),
        "domain_report": over(
            "exam",
            """SELECT 'domain' AS rule_type, 'SG_UF_PROVA' AS "column",
'Valores fora do domínio [''BA'', ''PA'', ''RJ'', ''SP'']' AS issue, count(*) AS affected_rows FROM exam
WHERE SG_UF_PROVA IS NULL OR SG_UF_PROVA NOT IN ('PA', 'SP', 'RJ', 'BA') HAVING count(*) > 0
UNION ALL SELECT 'domain', 'RENDA_FAMILIAR', 'Valores fora do domínio [''A'', ''B'', ''C'']', count(*) FROM exam
WHERE RENDA_FAMILIAR NOT IN ('A', 'B', 'C') HAVING count(*) > 0""",
        ),
        "dedup_two_keys": dedup("= 1"),
        "dedup_two_keys_rest": dedup("> 1"),
        "class_rows": CLASS_ROWS,
        "stream_classes": CLASS_ROWS,
        "adhoc_sql_all": over("exam", "SELECT ID_INSCRICAO, ANO, NU_IDADE FROM exam"),
        "class_summary": class_summary("TRUE"),
        "stream_class_summary": over(
            "classed",
            "SELECT class_name, coalesce(class_value, 'nan') AS class_value, count(*) AS total FROM ("
            + unpivot("classed", [], CLASS_COLUMNS.split(", "), "class_name", "class_value")
            + ") GROUP BY ALL",
        ),
        "class_alt": over(
            "exam",
            f"""SELECT ID_INSCRICAO, ANO, CASE WHEN NU_IDADE < 15 THEN '<15' WHEN NU_IDADE <= 17 THEN '15-17'
WHEN NU_IDADE <= 20 THEN '18-20' WHEN NU_IDADE <= 25 THEN '21-25' WHEN NU_IDADE <= 35 THEN '26-35'
WHEN NU_IDADE <= 50 THEN '36-50' ELSE '50+' END AS CLASS_FAIXA_ETARIA,
CASE WHEN m IS NULL THEN 'NA' WHEN m < 400 THEN 'BAIXA' WHEN m < 600 THEN 'MEDIA' WHEN m < 800 THEN 'ALTA'
ELSE 'EXCELENTE' END AS CLASS_NOTA_GLOBAL,
{case("RENDA_FAMILIAR", WAGE_RANGE_BY_LETTER, "RENDA_FAMILIAR")} AS CLASS_RENDA_FAMILIAR
FROM (SELECT *, {row_mean(["NOTA_LINGUAGENS_CODIGOS", "NOTA_MATEMATICA"])} AS m FROM exam)""",
        ),
        "class_custom": over(
            "classed",
            """SELECT ANO, CLASS_FAIXA_ETARIA || '/' || CLASS_NOTA_GLOBAL AS CLASS_PERFIL, count(*) AS total
FROM classed GROUP BY ALL""",
        ),
        "year_stats": over("stats", f"SELECT {STATS_OUT} FROM stats"),
        "geo_municipality": over("geo", f"SELECT {GEO_OUT} FROM geo"),
        "geo_state": over("geo_uf", f"SELECT {UF_OUT} FROM geo_uf"),
        "score_histogram": over("hist", "SELECT * FROM hist"),
        "income_box": over("box", f"SELECT CLASSE, {BOX_MEASURES}, COUNT, ANO FROM box"),
        "income_ordered": over(
            "box", f"SELECT ANO, CLASSE, COUNT, CASE CLASSE {ordinal} END AS ordinal FROM box"
        ),
        "mean5_rows": over("mean5", f"SELECT ID_INSCRICAO, ANO, {R4_SCORES}, MEDIA_5_DISC FROM mean5"),
        "state_bands": over("bands", "SELECT * FROM bands"),
        "state_bands_file": over(
            "mean5",
            """SELECT ANO, coalesce(SG_UF_PROVA, 'XX') AS SG_UF_PROVA, CASE WHEN MEDIA_5_DISC < 300 THEN 10 WHEN MEDIA_5_DISC < 452.5 THEN 20
  WHEN MEDIA_5_DISC < 700 THEN 30 ELSE 40 END AS ID_FAIXA, CASE WHEN MEDIA_5_DISC < 300 THEN 'Até 300' WHEN MEDIA_5_DISC < 452.5 THEN 'De 300 a 452,5'
  WHEN MEDIA_5_DISC < 700 THEN 'Meio' ELSE 'Alto # topo' END AS DESCRICAO_FAIXA, count(*) AS QTD_ALUNOS FROM mean5 GROUP BY ALL""",
        ),
        "state_bands_dense": over(
            "bands",
            f"""SELECT s.ANO, s.SG_UF_PROVA, b.id AS ID_FAIXA, b.label AS DESCRICAO_FAIXA,
coalesce(QTD_ALUNOS, 0) AS QTD_ALUNOS
FROM (SELECT DISTINCT ANO, SG_UF_PROVA FROM bands) s
CROSS JOIN (VALUES {", ".join(f"({b[0]}, {q(b[3])})" for b in MEAN_BANDS)}) b(id, label)
LEFT JOIN bands x ON x.ANO = s.ANO AND x.SG_UF_PROVA = s.SG_UF_PROVA AND x.ID_FAIXA = b.id""",
        ),
        "dim_municipality": over(
            "dim", "SELECT CO_MUNICIPIO_PROVA, NO_MUNICIPIO_PROVA, SG_UF_PROVA FROM dim WHERE SG_UF_PROVA IS NOT NULL"
        ),
        "year_counts": over("exam", "SELECT ANO, count(*) AS n_linhas_silver FROM exam GROUP BY ANO"),
        "gold_missing_columns": over(
            "exam",
            """SELECT * FROM (VALUES ('income', 8, 0::BIGINT), ('bands', 5, 0::BIGINT), ('histogram', 5, 0::BIGINT),
('towns', 15, 0::BIGINT)) t(dataset, columns, n) UNION ALL SELECT 'years', 2, count(DISTINCT ANO) FROM exam""",
        ),
        "pipeline_states": over(
            "silver",
            f"""SELECT CAST(ANO AS INTEGER) AS ANO, SG_UF_PROVA, count(ID_INSCRICAO) AS INSCRITOS,
{", ".join(f"count({s}) AS {s}_count, {r4(f'avg({s})', f'{s}_mean')}" for s in SCORES)}
FROM (SELECT *, row_number() OVER (PARTITION BY ANO, ID_INSCRICAO ORDER BY {KEY}) AS nth FROM silver)
WHERE nth = 1 AND SG_UF_PROVA IS NOT NULL GROUP BY ANO, SG_UF_PROVA""",
        ),
        "race_means": over("race", f"SELECT ANO, {RACE_OUT} FROM race"),
        "race_means_filtered": over(
            "exam",
            f"""SELECT CAST(NULL AS INTEGER) AS ANO, {case("TP_COR_RACA", RACE_LABELS, q("Não Disp."))} AS RACA,
{", ".join(r4(f"avg({s})", s) for s in SUBJECT_LABELS)}, count(*) AS COUNT FROM exam
WHERE ANO = {YEAR} AND SG_UF_PROVA = {q(RACE_STATE)} GROUP BY TP_COR_RACA HAVING count(*) > 100""",
        ),
        "race_means_town": over(
            "exam",
            f"""SELECT ANO, {case("TP_COR_RACA", RACE_LABELS, q("Não Disp."))} AS RACA,
{", ".join(r4(f"avg({s})", s) for s in SUBJECT_LABELS)}, count(*) AS COUNT FROM exam
WHERE {fold("NO_MUNICIPIO_PROVA")} = {q(fold_text(TOWN))} GROUP BY ANO, TP_COR_RACA HAVING count(*) > 5""",
        ),
        "income_year": over("box", f"SELECT CLASSE, {BOX_MEASURES} FROM box WHERE ANO = {YEAR}"),
        "municipality_list": town_names("geo", "true"),
        "municipality_list_state": town_names("dim", f"SG_UF_PROVA = {q(STATE)}"),
        "years_available": over(
            "stats", f"SELECT ANO FROM stats WHERE {' + '.join(f'{s}_count' for s in SCORES)} > 0"
        ),
        "stats_range": over("stats", f"SELECT {STATS_OUT} FROM stats WHERE ANO BETWEEN {FIRST} AND {LAST}"),
        "geo_page": over(
            "geo",
            f"""SELECT {PAGE_OUT} FROM (SELECT * FROM geo WHERE ANO IN (1997, {YEAR}, 1999)
AND SG_UF_PROVA IN ('CE', 'TO', 'MA') AND {min_counts(5)}
ORDER BY ANO DESC, SG_UF_PROVA, NO_MUNICIPIO_PROVA, CO_MUNICIPIO_PROVA LIMIT 20 OFFSET 20)""",
        ),
        "geo_page_names": over(
            "geo",
            f"""SELECT {PAGE_OUT} FROM geo
WHERE {fold("NO_MUNICIPIO_PROVA")} IN ({q(fold_text(TOWN))}, {q(fold_text(OTHER_TOWN))}) AND {min_counts(1)}""",
        ),
        "geo_page_count": over(
            "geo", f"SELECT count(*) AS total FROM geo WHERE ANO IN (1997, {YEAR}) AND {min_counts(5)}"
        ),
        "state_page": over("geo_uf", f"SELECT {UF_OUT} FROM geo_uf WHERE INSCRITOS >= 100"),
        "state_page_one": over(
            "geo_uf",
            f"SELECT {UF_OUT} FROM geo_uf WHERE INSCRITOS >= 10 AND ANO = {YEAR} AND SG_UF_PROVA = {q(STATE)}",
        ),
        "histogram_one": over("hist", f"SELECT * FROM hist WHERE ANO = {YEAR} AND DISCIPLINA = {q(SUBJECT)}"),
        "radar": radar(STATE),
        "radar_no_state": radar(None),
        "municipal_evolution": over(
            "evolution_rows",
            f"""SELECT shown AS NO_MUNICIPIO_PROVA, ANO,
{", ".join(r4(e, n) for n, e in EVOLUTION.items())}, INSCRITOS AS QTD_ALUNOS
FROM {evolution(f"ANO BETWEEN {FIRST} AND {LAST}")} WHERE nth = 1""",
        ),
        "bands_municipality": band_shares(SHARES_TOWN, "exam"),
        "bands_state": band_shares(SHARES_STATE, "bands"),
        "top_states": over(
            "geo_uf",
            f"""SELECT SG_UF_PROVA, {r4(METRIC, METRIC)} FROM geo_uf WHERE ANO = {YEAR} AND INSCRITOS >= 100
ORDER BY geo_uf.{METRIC} DESC, SG_UF_PROVA LIMIT 5""",
        ),
        "adhoc_sql": over(
            "geo_uf",
            f"""SELECT ANO, {r4("max(NOTA_REDACAO_mean)", "best")}, CAST(sum(INSCRITOS) AS BIGINT) AS enrolled
FROM geo_uf WHERE ANO >= {FIRST} GROUP BY ANO""",
        ),
        "state_weighted": over(
            "geo_uf",
            f"""SELECT SG_UF_PROVA AS uf, CAST(sum(INSCRITOS) AS BIGINT) AS inscritos,
{weighted("NOTA_MATEMATICA_mean", "mat")}, {weighted("NOTA_CIENCIAS_NATUREZA_mean", "nat")},
{weighted("NOTA_CIENCIAS_HUMANAS_mean", "hum")}, {weighted("NOTA_LINGUAGENS_CODIGOS_mean", "lin")},
{weighted("NOTA_REDACAO_mean", "red")} FROM geo_uf GROUP BY SG_UF_PROVA""",
        ),
        "race_history": race_history(),
        "year_unweighted": over(
            "geo_uf",
            f"""SELECT CAST(y AS INTEGER) AS ANO, {uf_means}
FROM range({FIRST}, 2004) t(y) LEFT JOIN geo_uf ON ANO = y GROUP BY y""",
        ),
        "metric_matrix": over(
            "geo_uf",
            f"""SELECT CAST(ANO AS VARCHAR) AS year, SG_UF_PROVA AS uf, {r4(METRIC, "value")}
FROM geo_uf WHERE ANO BETWEEN {FIRST} AND {LAST} AND {METRIC} IS NOT NULL""",
        ),
        "histogram_peak": over(
            "hist",
            """SELECT *, row_number() OVER (PARTITION BY ANO, DISCIPLINA ORDER BY CONTAGEM DESC, BIN_START) = 1 AS is_peak
FROM hist""",
        ),
        "race_rank": over("race_year", f"SELECT RACA, {r4(row_mean(SCORES), 'score')}, COUNT FROM race_year"),
        "race_rank_subject": over("race_year", f"SELECT RACA, {r4(SUBJECT, 'score')}, COUNT FROM race_year"),
        "municipality_kpi": over(
            "geo",
            f"""SELECT CAST(coalesce(sum(INSCRITOS), 0) AS BIGINT) AS total_inscritos,
CAST(coalesce(sum(NOTA_REDACAO_count), 0) AS BIGINT) AS total_provas,
coalesce({f"round(avg(({kpi}) / 5), 4)"}, 0) AS media_geral
FROM geo WHERE {fold("NO_MUNICIPIO_PROVA")} = {q(fold_text(TOWN))}""",
        ),
        "subject_series": over(
            "evolution_rows",
            f"""SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY ANO) - 1 AS INTEGER) AS pos,
ANO, {r4("value", "value")} FROM ({series})""",
        ),
        "year_last": over(
            "geo_uf",
            f"""SELECT CAST(ANO AS VARCHAR) AS ANO, SG_UF_PROVA, INSCRITOS, {GEO_MEASURES}
FROM (SELECT *, row_number() OVER (PARTITION BY ANO ORDER BY SG_UF_PROVA DESC) AS nth FROM geo_uf) WHERE nth = 1""",
        ),
        "map_extent": over(
            "geo_uf",
            f"""SELECT SG_UF_PROVA AS uf, {r4(METRIC, "value")}, {r4(f"min({METRIC}) OVER ()", "min_value")},
{r4(f"max({METRIC}) OVER ()", "max_value")} FROM geo_uf WHERE ANO = {YEAR} AND {METRIC} IS NOT NULL""",
        ),
        "map_keys": over(
            "geo_uf",
            f"""SELECT 'BR-' || SG_UF_PROVA AS id, ANO, {r4(METRIC, "value")} FROM geo_uf WHERE {METRIC} IS NOT NULL""",
        ),
        "national_history": over(
            "stats",
            f"""SELECT CAST(ANO AS VARCHAR) AS ANO, TOTAL_INSCRITOS AS INSCRITOS,
{", ".join(r4(f"{s}_mean", f"{s}_mean") for s in SCORES)} FROM stats WHERE ANO BETWEEN {FIRST} AND {LAST}""",
        ),
        "band_total": over(
            "bands", f"SELECT CAST(sum(QTD_ALUNOS) AS BIGINT) AS total FROM bands WHERE SG_UF_PROVA = {q(STATE)}"
        ),
        "race_chart": over("race_year", f"SELECT {RACE_OUT} FROM race_year"),
        "year_choices": over("stats", f"SELECT ANO FROM stats WHERE ANO >= {FIRST}"),
        "default_years": over("stats", f"SELECT ANO FROM stats WHERE ANO >= {FIRST} ORDER BY ANO DESC LIMIT 3"),
        "checks": checks(),
        "gate": checks(),
        "clean_plan": over("kept", "SELECT ANO, count(*) AS n, count(*) FILTER (RENDA_FAMILIAR = 'UNKNOWN') AS unknown FROM kept GROUP BY ANO"),
        "renamed_columns": over(
            "exam",
            """SELECT '  ' || ID_INSCRICAO || ' ' AS ID_INSCRICAO, NO_MUNICIPIO_PROVA, CAST(NU_IDADE AS VARCHAR) AS NU_IDADE,
' ' || lower(TP_SEXO) AS TP_SEXO FROM exam""",
        ),
        "required_columns": f"""SELECT * FROM (VALUES ('complete', ''), ('other name', ''),
('no identifier', 'required columns missing for {YEAR}: [''NU_INSCRICAO'']'), ('no rows', 'raw data for {YEAR} is empty')) t(name, refusal)""",
        "metadata_year": over(
            "exam",
            f"""SELECT y AS ano, nome_padrao, tipo_padrao, domain FROM (SELECT DISTINCT ANO AS y FROM exam WHERE ANO = {YEAR})
CROSS JOIN (VALUES ('RENDA_FAMILIAR', 'string', 'A,B'), ('TP_COR_RACA', 'Int64', '0,1,2,3,4,5'), ('TP_ETNIA', 'string', '0,1,2,3,4,5'),
('TP_SEXO', 'string', 'F,M'), ('IDADE', 'Int64', ''), ('NU_ANO', 'int32', ''), ('MUNICIPIO_PROVA', 'text', '')) t(nome_padrao, tipo_padrao, domain)""",
        ),
        "published_views": published(
            " UNION ALL ".join(f"SELECT '{view}' AS view, count(*) AS n FROM {src}" for view, src in PUBLISHED.items())
        ),
        "published_columns": "SELECT * FROM (VALUES "
        + ", ".join(f"('{t}', '{c}', '{k}', {i})" for t, columns in PUBLISHED_COLUMNS.items() for i, (c, k) in enumerate(columns))
        + ") t(table_name, column_name, column_type, position)",
        "audit_saved": published(
            f"""SELECT 'silver' AS layer, ANO AS ano, 'silver' AS parquet_path, count(*) AS row_count, {len(EXAM_COLUMNS)} AS column_count,
'IDADE,MUNICIPIO_PROVA,NU_ANO,TP_ETNIA' AS missing_expected_columns FROM raw WHERE ANO BETWEEN {FIRST} AND {LAST} GROUP BY ANO """
            + " ".join(
                f"UNION ALL SELECT 'gold', NULL, '{t}', count(*), {n}, '' FROM {PUBLISHED['gold_' + t if t != 'dim_municipio' else t]}"
                for t, n in (
                    ("tb_notas", 10), ("tb_notas_stats", 37), ("tb_notas_geo", 15), ("tb_notas_geo_uf", 13), ("tb_notas_histogram", 5),
                    ("tb_socio_economico", 8), ("tb_media_uf", 5), ("dim_municipio", 3),
                )
            )
        ),
        "report_summary": over(
            "geo",
            f"""SELECT ANO AS "Ano", SG_UF_PROVA AS "UF", {title("NO_MUNICIPIO_PROVA")} AS "Município", INSCRITOS AS "Inscritos",
'Anos: {FIRST}, {YEAR} | UFs: {STATE}' AS "Filtros" FROM geo WHERE ANO IN ({FIRST}, {YEAR}) AND SG_UF_PROVA = {q(STATE)} AND {min_counts(30)}""",
        ),
        "audit": over(
            "exam",
            f"""SELECT 'silver' AS layer, ANO AS ano, 'exam' AS parquet_path, count(*) AS row_count,
{len(EXAM_COLUMNS)} AS column_count, true AS has_ano_column, 'TP_FAIXA_ETARIA' AS missing_expected_columns,
{q(",".join(untracked))} AS columns_not_in_metadata, array_to_string([{audit_names}][1:20], ',') AS column_sample,
CAST(NULL AS VARCHAR) AS notes FROM exam GROUP BY ANO""",
        ),
        "mask": over(
            "exam",
            f"""SELECT {masked("ID_INSCRICAO")} AS NU_INSCRICAO, ID_INSCRICAO, repeat('*', length(Q006)) AS email, ANO,
CASE WHEN length(ID_INSCRICAO) <= 4 THEN repeat('*', length(ID_INSCRICAO))
     ELSE substring(sha256(ID_INSCRICAO), 1, 16) END AS digest FROM exam""",
        ),
        "report_rows": over(
            "geo",
            f"""SELECT ANO AS "Ano", SG_UF_PROVA AS "UF", {title("NO_MUNICIPIO_PROVA")} AS "Município",
INSCRITOS AS "Inscritos", NOTA_REDACAO_count AS "Provas Aplicadas", {report_scores}
FROM geo WHERE ANO = {YEAR} AND {min_counts(30)}""",
        ),
        "report_text": over(
            "geo",
            f"""SELECT CAST(ANO AS VARCHAR) AS "Ano", SG_UF_PROVA AS "UF", d AS "Município",
CAST(INSCRITOS AS VARCHAR) AS "Inscritos", CAST(NOTA_REDACAO_count AS VARCHAR) AS "Provas Aplicadas",
total > 25 AS truncated FROM (SELECT *, {title("NO_MUNICIPIO_PROVA")} AS d, count(*) OVER () AS total
FROM geo WHERE ANO = {YEAR}) ORDER BY SG_UF_PROVA, d LIMIT 25""",
        ),
        "export_cells": over(
            "exam",
            """SELECT ID_INSCRICAO, CAST(ANO AS VARCHAR) AS ANO, coalesce(SG_UF_PROVA, '') AS SG_UF_PROVA,
NO_MUNICIPIO_PROVA || ',' || TP_SEXO AS NO_MUNICIPIO_PROVA, coalesce(CAST(TP_COR_RACA AS VARCHAR), '') AS TP_COR_RACA
FROM exam""",
        ),
        "export_labelled": labelled(
            "geo", min_counts(1), 'ANO AS "Ano", SG_UF_PROVA AS "UF", NO_MUNICIPIO_PROVA AS "Município"'
        ),
        "export_labelled_states": labelled(
            "geo_uf", "true", 'ANO AS "Ano", SG_UF_PROVA AS "UF", INSCRITOS AS "Inscritos"'
        ),
    }
    return out
