"""Extraction rules over all documents, by inventory number, and DuckDB SQL for the same rows.

The tables hold few of what these rules look for, so each document gets one of SEEDS as its last line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import classify, entities, text
from foliant.plans.archive import docs, query

SEEDS = [
    "CPF 111.444.777-35 e 123.456.789-00 e 11144477735, CNPJ 11.222.333/0001-81 e 11.222.333/0001-82",
    "Contratante: ACME  Ltda",
    "valor R$ 10.000,00 e USD 5.000 e € 12,5 e R$ 10.000,00 e R$ 3 mil",
    "SECRET",
    "Classificação: uso interno, prestação de serviços e ICMS",
    "contrato, cláusula, vigência e obrigações das partes contratantes",
    "Réu: João da Silva",
    "DECLASSIFIED",
    "assunto: nota fiscal, danfe e cfop com icms; invoice",
    "a – b  −  c",
]
quoted = lambda s: "'" + s.replace("'", "''") + "'"
SEEDED = f"d as (select doc_id, coalesce(text, '') || chr(10) || ([{', '.join(map(quoted, SEEDS))}])[doc_id % {len(SEEDS)} + 1] as text from documents)"


def seeded(spark: SparkSession, sf: str) -> DataFrame:
    seed = F.element_at(F.array(*map(F.lit, SEEDS)), (F.col("doc_id") % len(SEEDS) + 1).cast("int"))
    return docs(spark, sf).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), seed).alias("text"))


def _values(spark: SparkSession, sf: str, values) -> DataFrame:
    return seeded(spark, sf).select("doc_id", F.explode(F.array_distinct(values)).alias("value"))


DIGITS = r"list_transform(string_split(regexp_replace(value, '\D', '', 'g'), ''), lambda x: cast(x as integer)) as g"
_check = lambda weights: f"(list_sum(list_transform(list_zip(g[:{len(weights)}], {weights}), lambda p: p[1] * p[2])) % 11)"
_digit = lambda weights: f"(g[{len(weights) + 1}] = case when {_check(weights)} < 2 then 0 else 11 - {_check(weights)} end)"
CPF = [10, 9, 8, 7, 6, 5, 4, 3, 2]
found_sql = lambda pattern: f"with {SEEDED}, v as (select distinct doc_id, unnest(regexp_extract_all(text, {quoted(pattern)})) as value from d), w as (select *, {DIGITS} from v)"
query("i19_cpf_check", found_sql(entities.MASKS["cpf"]) + f" select doc_id, value, len(list_distinct(g)) > 1 and {_digit(CPF)} and {_digit([11, *CPF])} as ok from w")(lambda s, d: _values(s, d, entities.mask(F.col("text"), "cpf")).withColumn("ok", entities.valid_cpf(F.col("value"))))
NUMERIC_CNPJ = "|".join(entities.MASKS["cnpj"].split("|")[:2])
query("i20_cnpj_check", found_sql(NUMERIC_CNPJ) + f" select doc_id, value, len(list_distinct(g)) > 1 and {_digit(entities.CNPJ_WEIGHTS[1:])} and {_digit(entities.CNPJ_WEIGHTS)} as ok from w")(lambda s, d: _values(s, d, entities.mask(F.col("text"), "cnpj")).where("not value rlike '[A-Za-z]'").withColumn("ok", entities.valid_cnpj(F.col("value"))))

_money = " union all ".join(f"select doc_id, {i} as c, '{k}' as currency, unnest(h) as v, generate_subscripts(h, 1) as i from (select doc_id, regexp_extract_all(text, {quoted(p)}) as h from d)" for i, (k, p) in enumerate(entities.MONEY.items()))
query("i23_money", f"with {SEEDED}, m as ({_money}), f as (select doc_id, c, currency, trim(v) as v, min(i) as i from m where regexp_matches(v, '[0-9]') group by all), r as (select *, row_number() over (partition by doc_id order by c, i) as r from f) select d.doc_id, coalesce(string_agg(currency || ' ' || v, ';' order by r), '') as money from d left join (select * from r where r <= 20) r on r.doc_id = d.doc_id group by 1")(lambda s, d: seeded(s, d).select("doc_id", F.array_join(F.transform(entities.money(F.col("text")), lambda m: F.concat_ws(" ", m["currency"], m["value_str"])), ";").alias("money")))

PARTIES = f"{SEEDED}, h as (select doc_id, regexp_extract_all(text, {quoted(rf'(?im)^[\s]*(?:{entities.PARTY_LABELS})\b[:\s]*([^\n]{{3,80}})')}, 1) as h from d), u as (select doc_id, substr(regexp_replace(trim(unnest(h)), '\\s+', ' ', 'g'), 1, 100) as p, generate_subscripts(h, 1) as i from h), f as (select doc_id, p, min(i) as i from u where length(p) > 2 group by 1, 2), parties as (select * from f qualify row_number() over (partition by doc_id order by i) <= 15)"
query("i24_parties", f"with {PARTIES} select d.doc_id, coalesce(string_agg(p, ';' order by i), '') as parties from d left join parties p on p.doc_id = d.doc_id group by 1")(lambda s, d: seeded(s, d).select("doc_id", F.array_join(entities.parties(F.col("text")), ";").alias("parties")))
ORGANISED = "[" + ", ".join(map(quoted, entities.ORGANISATION)) + "]"
query("i44_party_type", f"with {PARTIES} select doc_id, p as value, case when len(list_filter({ORGANISED}, lambda w: contains(lower(p), w))) > 0 then 'org' when len(string_split_regex(trim(lower(p)), '\\s+')) >= 2 then 'person' else 'org' end as type from parties")(lambda s, d: _values(s, d, entities.parties(F.col("text"))).withColumn("type", entities.party_type(F.col("value"))))

_points = ", ".join("(" + " + ".join(f"(case when contains(head, {quoted(w)}) then 2 else 0 end + case when contains(rest, {quoted(w)}) then 1 else 0 end)" for w in ws) + ")" for ws in classify.KEYWORDS.values())
_labels = "[" + ", ".join(map(quoted, classify.KEYWORDS)) + "]"
_re2 = lambda p: quoted(p.replace("(?iu)", "(?i)"))
TYPED = (
    f"{SEEDED}, h as (select doc_id, text, lower(substr(text, 1, 8000)) as raw from d), s as (select *, substr(raw, 1, 1500) as head, substr(raw, 1501, 8000) as rest from h), p as (select *, [{_points}] as p from s), b as (select *, list_max(p) as best, least(1.0, list_max(p) / 15.0) as sure from p), "
    f"typed as (select doc_id, text, case when trim(raw) = '' then 'documento' when best > 0 and sure < 0.10 then 'documento' when best > 0 then ({_labels})[list_position(p, best)] when regexp_matches(substr(raw, 1, 500), {_re2(classify.EMAIL_HINT)}) then 'e-mail' when regexp_matches(substr(raw, 1, 500), {_re2(classify.INVOICE_HINT)}) then 'fatura' else 'documento' end as label, "
    f"case when trim(raw) = '' then 0.0 when best > 0 and sure < 0.10 then sure when best > 0 then round_even(sure, 2) when regexp_matches(substr(raw, 1, 500), {_re2(classify.EMAIL_HINT)}) or regexp_matches(substr(raw, 1, 500), {_re2(classify.INVOICE_HINT)}) then 0.5 else 0.0 end as confidence from b)"
)
query("i28_document_type", f"with {TYPED} select doc_id, label, round(cast(confidence as double), 4) as confidence from typed")(lambda s, d: seeded(s, d).select("doc_id", classify.document_type(F.col("text")).alias("r")).select("doc_id", "r.label", F.round("r.confidence", 4).alias("confidence")))
_tags = ", ".join(f"case when {' or '.join(f'contains(low, {quoted(w)})' for w in ws)} then {quoted(t)} end" for t, ws in entities.TAGS.items())
query("i25_tags", f"with {TYPED}, l as (select *, lower(substr(text, 1, 6000)) as low from typed) select doc_id, array_to_string(list_filter([case when label <> 'documento' then label end, {_tags}], lambda t: t is not null)[:10], ',') as tags from l")(lambda s, d: seeded(s, d).select("doc_id", F.array_join(entities.tags(classify.document_type(F.col("text"))["label"], F.col("text")), ",").alias("tags")))

_level = lambda k, p: f"when regexp_matches(head, {quoted('(?im)(?:' + (entities.LINE_OR_CLASS if k in entities.WITHOUT_LABEL else entities.LINE_OR_CLASS + '|' + entities.SECRECY_LABEL) + ')(?:' + p + r')\b')}) then {quoted(k)}"
query("i26_confidentiality", f"with {SEEDED}, h as (select doc_id, substr(text, 1, 30000) as head from d) select doc_id, case when regexp_matches(head, {quoted('(?i)' + entities.RELEASED)}) then null {' '.join(_level(k, p) for k, p in entities.LEVELS.items())} end as level from h")(lambda s, d: seeded(s, d).select("doc_id", entities.confidentiality(F.col("text")).alias("level")))

BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
query("i1_normalize_text", rf"with {SEEDED} select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{2010}}-\x{{2015}}\x{{2212}}]', '-', 'g'), '[ \t\x{{a0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{BLANK}|{BLANK}$', '', 'g') as t from d")(lambda s, d: seeded(s, d).select("doc_id", text.normalize_text(F.col("text")).alias("t")))
