"""Document types and languages by words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let

# Words of each document type, in the order that decides ties.
KEYWORDS = {
    "contrato": ["contrato", "cláusula", "obrigações", "vigência", "pacto", "outorgantes", "partes contratantes", "contratante", "contratada"],
    "edital": ["edital", "concurso público", "licitação", "pregão", "tomada de preços", "convite", "chamamento público", "processo seletivo", "inscrições", "candidatos"],
    "nota_fiscal": ["nota fiscal", "nf-e", "danfe", "cfop", "icms", "chave de acesso", "natureza da operação", "dados do emitente"],
    "relatório": ["relatório", "recomendações", "análise técnica", "objetivo do relatório", "executive summary", "findings", "scope of work"],
    "procuração": ["procuração", "outorgante", "outorgado", "substabelecer", "poderes especiais"],
    "petição": ["petição", "exmo", "meritíssimo", "juiz", "requer", "impetrante", "réu"],
    "recibo": ["recibo", "recebi de", "quitância", "quitado"],
    "ata": ["ata de reunião", "ata da reunião", "sessão pública", "deliberação", "lavrada a ata", "ordem do dia"],
    "certidão": ["certidão", "certifico", "cartório", "atesto que", "certifica-se", "certidão de nascimento", "certidão de óbito"],
    "comprovante": ["comprovante de pagamento", "comprovante de transferência", "nº do cartão", "código de autenticação", "ted realizada", "pix realizado", "boleto pago"],
    "apresentação": ["slide", "apresentação executiva", "sumário executivo", "agenda da reunião"],
    "manual": ["manual de", "instruções de uso", "passo a passo", "como usar", "guia do usuário"],
    "artigo": ["abstract", "keywords", "referências bibliográficas", "metodologia", "doi:", "issn", "received:", "accepted:"],
    "registro": ["registro do movimento", "livro nº", "procedência", "nacionalidade", "imigrantes", "vapor em que veio", "número de ordem"],
    "lista": ["relação nominal", "nome sexo idade", "lista de presença", "lista de inscritos"],
    "política": ["política de privacidade", "política de segurança", "política de uso", "termos de uso", "termos e condições", "tratamento de dados", "lgpd", "gdpr", "dados pessoais"],
}
# Hints of an e-mail and of an invoice at the top of a text.
EMAIL_HINT = r"(?iu)\b(?:e-?mail|assunto|from:|to:|destinatário|remetente|para:|cc:)\b"
INVOICE_HINT = r"(?iu)\b(?:invoice|fatura|faturamento|nota\s*fiscal|nf-?e|valor\s*total)\b"
# Common words.
COMMON_PT = ["de", "da", "do", "que", "e", "um", "uma", "os", "as", "no", "na", "por", "para", "com", "não", "mais", "ao", "ela", "em", "dos", "das"]
COMMON_EN = ["the", "of", "and", "to", "a", "in", "that", "is", "it", "for", "you", "was", "on", "are", "with", "as", "be", "have", "this"]


# Pieces of file names and the type that they settle, in order; "ata" only in short names.
NAME_HINTS = [
    ("edital", ["edital"]),
    ("contrato", ["contrat", "contract"]),
    ("nota_fiscal", ["nota_fiscal", "notafiscal", "danfe"]),
    ("recibo", ["recibo"]),
    ("procuração", ["procuracao", "procuração"]),
    ("petição", ["peticao", "petição"]),
    ("política", ["politica", "política", "privacidade"]),
    ("relatório", ["relatorio", "relatório", "report"]),
    ("registro", ["registro", "livro", "rjanrio", "hif"]),
]
ATA_NAME, NAME_CONFIDENCE = 30, 0.9


def type_by_name(name: Column) -> Column:
    """The type that a file's name settles; null if it settles none."""
    n = F.lower(F.coalesce(name, F.lit("")))
    hits = [F.when(F.greatest(*[n.contains(w) for w in [*words, words[0]]]), F.lit(t)) for t, words in NAME_HINTS]
    return F.coalesce(*hits, F.when(n.contains("ata") & (F.length(n) < ATA_NAME), F.lit("ata")))


def classified(name: Column, text: Column) -> Column:
    """struct<label, confidence>: by the file's name, else by the text."""
    by_name = type_by_name(name)
    return F.when(by_name.isNotNull(), F.struct(by_name.alias("label"), F.lit(NAME_CONFIDENCE).alias("confidence"))).otherwise(document_type(text))


def metadata_hint(title: Column, subject: Column, keywords: Column) -> Column:
    """"title: ... | subject: ..." of what isn't blank."""
    part = lambda k, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{k}: "), F.trim(c)))
    return F.concat_ws(" | ", part("title", title), part("subject", subject), part("keywords", keywords))


def document_type(text: Column) -> Column:
    """struct<label, confidence>: 2 for a word in the first 1500 characters, 1 for one in the rest of 8000; 15 is certain.

    Ties go to the earlier type. Under 0.10 the label is "documento"; without any word the top of the text may still
    look like an e-mail or an invoice (0.5)."""
    return let(F.lower(F.substring(text, 1, 8000)), lambda raw: let(_best(raw), lambda best: _judged(raw, best)))


def _best(raw: Column) -> Column:
    """struct<score, order, label> of the type with most points."""
    head, rest = F.substring(raw, 1, 1500), F.substring(raw, 1501, 8000)
    points = lambda ws: sum((F.when(head.contains(w), 2).otherwise(0) + F.when(rest.contains(w), 1).otherwise(0) for w in ws), F.lit(0))
    return F.array_max(F.array(*[F.struct(points(ws).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, (k, ws) in enumerate(KEYWORDS.items())]))


def _judged(raw: Column, best: Column) -> Column:
    sure = F.least(F.lit(1.0), best["score"] / 15.0)
    top = F.substring(raw, 1, 500)
    result = lambda label, c: F.struct(label.alias("label"), c.alias("confidence"))
    none = F.lit("documento")
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", result(none, F.lit(0.0)))
        .when((best["score"] > 0) & (sure < 0.10), result(none, sure))
        .when(best["score"] > 0, result(best["label"], F.bround(sure, 2)))
        .when(top.rlike(EMAIL_HINT), result(F.lit("e-mail"), F.lit(0.5)))
        .when(top.rlike(INVOICE_HINT), result(F.lit("fatura"), F.lit(0.5)))
        .otherwise(result(none, F.lit(0.0)))
    )


def language(text: Column) -> Column:
    """pt-BR or en, whichever has more of its common words among the distinct words; "unknown" at a tie."""
    words = F.array_distinct(F.split(F.lower(text), r"(?U)[^\w]+"))
    n = lambda ws: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws])))
    pt, en = n(COMMON_PT), n(COMMON_EN)
    return F.when(pt > en, F.lit("pt-BR")).when(en > pt, F.lit("en")).otherwise(F.lit("unknown"))
