"""Masks and entity extraction, check digits, money, parties, tags, confidentiality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let

# Top-level domains, those with which a root of three characters is enough, roots that are words, damaged "www".
TLDS = "com|org|net|gov|edu|mil|int|info|biz|name|pro|aero|asia|cat|coop|jobs|mobi|museum|tel|travel|xxx|io|ai|app|dev|tech|online|site|xyz|me|co|tv|cc|ly|us|uk|br|pt|es|fr|de|it|nl|be|lu|ch|at|se|no|fi|dk|pl|cz|sk|hu|gr|ro|bg|ua|ru|tr|il|ae|sa|za|eg|ma|ng|ke|jp|cn|hk|tw|kr|in|id|my|sg|th|ph|vn|au|nz|ca|mx|ar|cl|co|pe|uy|bo|ve|cr|pa"
COMMON_TLDS = ["com", "org", "net", "gov", "edu", "mil", "int", "info", "biz", "br", "pt", "es", "fr", "uk", "us", "ca", "au", "jp", "cn", "kr", "it"]
WORD_ROOTS = [
    "in", "on", "at", "is", "it", "me", "my", "or", "as", "to", "do", "go", "so", "be", "of", "if", "no", "we", "he", "us", "an", "by", "up", "the", "and",
    "for", "but", "you", "are", "not", "all", "any", "can", "had", "her", "his", "how", "one", "our", "out", "see", "two", "who", "use", "de", "da", "do", "em",
    "no", "na", "os", "as", "se", "um", "uma", "que", "por", "com", "sem", "mas", "mio", "el", "la", "en", "es", "lo", "ya", "su", "yo", "ver", "ser",
]
DOMAIN = rf"(?i)(?<![\w.-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:{TLDS})(?![\w-])"
# Patterns of the masks, in the order in which a span is given to the first that matches it.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_SOCIAL = r"(?i)(?:https?://)?(?:www\.)?"
MASKS = {
    "ipv4": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "ipv6": rf"\b(?:{_HEX}:){{7}}{_HEX}\b|\b::(?:{_HEX}:)*{_HEX}?\b|\b(?:{_HEX}:)+::(?:{_HEX}:)*{_HEX}?\b",
    "cpf": r"\b\d{3}(?:\.\d{3}){2}-\d{2}\b|\b\d{11}\b",
    "cnpj": r"\b\d{2}(?:\.\d{3}){2}/\d{4}-\d{2}\b|\b\d{14}\b|\b[A-Za-z0-9]{2}(?:\.[A-Za-z0-9]{3}){2}/[A-Za-z0-9]{4}-\d{2}\b",
    "email": r"\b[\w.%-+]+@(?:[\w-]+\.)+[A-Za-z]{2,}\b",
    "domain": DOMAIN,
    "url": r"(?i)https?://[^\s<>\"']+",
    "social_twitter": _SOCIAL + r"(?:twitter\.com|x\.com)/\S+",
    "social_instagram": _SOCIAL + r"(?:instagram\.com)/\S+",
    "social_facebook": _SOCIAL + r"(?:fb\.com|facebook\.com)/\S+",
    "social_linkedin": _SOCIAL + r"(?:linkedin\.com)/\S+",
}
ALIASES = {"ip": ["ipv4", "ipv6"], "e-mail": ["email"], "link": ["url"], "dominio": ["domain"], "domínio": ["domain"], "fqdn": ["domain"], "twitter": ["social_twitter"], "instagram": ["social_instagram"], "facebook": ["social_facebook"], "linkedin": ["social_linkedin"]}
# Further entities.
ENTITIES = {
    "ceps": r"(?<!\d)\d{5}-\d{3}(?!\d)",
    "processos": r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b",
    "hashes": r"(?i)\b[a-f0-9]{32}(?:[a-f0-9]{8}(?:[a-f0-9]{24})?)?\b",
    "timestamps": r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:[+-]\d{2}:?\d{2}|Z)?\b",
    "placas": r"\b(?!(?i:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC))[A-Z]{3}-?\d[A-Z0-9]\d{2}\b",
    "phones": r"(?<!\d)(?:\+55[\s.-]?\(?[1-9]\d\)?[\s.-]?9?\d{4}[-.\s]\d{4}|\([1-9]\d\)[\s.-]?9?\d{4}[-.\s]\d{4}|[1-9]\d[\s.-]9?\d{4}[-.]\d{4})(?!\d)",
    "protocolos": r"(?i)\b(?:Protocolo|Ref|Ofício|Memorando|SEI)\.?\s*(?:n[.ºo°]?\s*)?(?=[A-Z./-]*\d)[\dA-Z][\dA-Z./-]{2,30}\b",
    "leis": r"(?i)\b(?:Lei|Art(?:igo)?|Decreto|Portaria|Instrução\s+Normativa|Resolução|Medida\s+Provisória|Emenda\s+Constitucional)\.?\s*(?:n[.ºo°]?\s*)?\d[\d./-]{0,20}\d",
}
RG = r"(?i)\b(?:RG|R\.G\.|Identidade|Carteira\s+de\s+Identidade)\s*[:nº.°]*\s*(\d[\d.\s-]{4,14}\d[- ]?[A-Za-z0-9]?)"
COORDINATES = r"(-?\d{1,3}\.\d{4,8})\s*[,;\s]\s*(-?\d{1,3}\.\d{4,8})"
DAMAGED_WWW = "^(?i)[a-z]?v?w{2,3}$"
# Currencies in the order in which they are listed.
MONEY = {
    "BRL": r"(?i)\bR\s*\$\s*\d[\d.,]*(?:\s*(?:mil|milhão|milhões|k|mm|mi))?",
    "EUR": r"(?i)\b(?:EUR\s*(?:€\s*)?[\d.,]+|€\s*[\d.,]+|[\d.,]+\s*€)",
    "USD": r"(?i)\b(?:USD\s*(?:\$\s*)?[\d.,]+|[\d.,]+\s*USD)",
}
# Role labels at the start of a line.
PARTY_LABELS = "Parte\\s+[A-Za-z]|Outorgante|Outorgado|Presentes?|Requerente|Autor|Réu|Contratante|Contratada|Fornecedor|Cliente|Testemunha|Vendedor|Comprador|Exequente|Executado"
# Tags and the words that suggest them.
TAGS = {
    "trabalhista": ["trabalhista", "clt", "consolidação das leis do trabalho"],
    "serviço": ["serviço", "prestação de serviços", "serviços"],
    "compra": ["compra e venda", "compraventa", "aquisição"],
    "societário": ["societário", "sociedade", "quotas", "acionista"],
    "imigração": ["imigração", "imigrantes", "nacionalidade", "procedência", "entrada"],
    "histórico": ["registro do movimento", "livro", "arquivo histórico"],
    "fiscal": ["icms", "cfop", "tributo", "imposto", "nota fiscal"],
    "judicial": ["juiz", "petição", "autor", "réu", "processo"],
}
# Levels of confidentiality, most restrictive first, and their stamps; what stands before a stamp; markers of released documents.
LEVELS = {
    "ULTRASSECRETO": r"ULTRA[- ]?SECRETO|TOP\s*SECRET|TR[EÈ]S\s+SECRET|STRENG\s+GEHEIM|SEGRETISSIMO|ALT[IÍ]SIMO\s+SECRETO|СОВЕРШЕННО\s+СЕКРЕТНО|绝密|極秘|극비|سري\s+للغاية",
    "SECRETO": r"SECRETO|SECRET|GEHEIM|SEGRETO|СЕКРЕТНО|机密|秘密|機密|비밀|سري",
    "CONFIDENCIAL": r"CONFIDENCIAL|CONFIDENTIAL|CONFIDENTIEL|VERTRAULICH|CONFIDENZIALE|КОНФИДЕНЦИАЛЬНО|机密文件|محرم",
    "RESERVADO": r"RESERVADO|RESTRICTED|DIFFUSION\s+RESTREINTE|RESERVIERT|RISERVATO|ДЛЯ\s+СЛУЖЕБНОГО\s+ПОЛЬЗОВАНИЯ|内部使用",
    "SIGILOSO": r"SIGILOSO|CLASSIFIED|CLASSIFI[EÉ]",
    "USO INTERNO": r"USO\s+INTERNO|INTERNAL\s+USE(?:\s+ONLY)?",
    "PÚBLICO": r"P[ÚU]BLICO|PUBLIC\s+DOCUMENT",
}
LINE_OR_CLASS = r"^[\t ]*|Classifica[cç][aã]o\s*[:\-]\s*"
SECRECY_LABEL = r"N[ií]vel\s+de\s+sigilo\s*[:\-]\s*"
#: Levels that only the first two introduce.
WITHOUT_LABEL = ["USO INTERNO", "PÚBLICO"]
RELEASED = r"\b(?:DECLASSIFIED|DESCLASSIFICADO|APPROVED\s+FOR\s+RELEASE|SANITIZED\s+COPY|FOIA|FREEDOM\s+OF\s+INFORMATION|NARA|JFK\s+ASSASSINATION\s+RECORDS)\b"
# Words of organisations' names.
ORGANISATION = ["ltda", "s.a.", "s/a", "sa ", "eireli", "epp", "me ", "inc.", "corp.", "empresa", "companhia", "associação", "fundação", "instituto", "banco", "município", "estado ", "união ", "federal", "ministério", "secretaria", "prefeitura", "câmara", "tribunal", "universidade", "faculdade"]
# Weights of check digits.
CNPJ_WEIGHTS = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


def found(text: Column, pattern: str, most: int = 30, group: int = 0) -> Column:
    """Distinct matches in order of first occurrence, at most so many."""
    hits = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group)), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(hits, lambda x: x != "")), 1, most)


def mask(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + MASKS[name]), F.lit(0))


def _check(digits: Column, weights: list[int]) -> Column:
    total = sum((digits.substr(i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0)) % 11
    return F.when(total < 2, F.lit(0)).otherwise(11 - total)


def valid_cpf(value: Column) -> Column:
    """Eleven digits, not all equal, with both check digits right."""
    d = F.regexp_replace(value, r"\D", "")
    right = (d.substr(10, 1).try_cast("int") == _check(d, list(range(10, 1, -1)))) & (d.substr(11, 1).try_cast("int") == _check(d, list(range(11, 1, -1))))
    return F.when((F.length(d) == 11) & ~d.rlike(r"^(\d)\1*$"), right).otherwise(F.lit(False))


def valid_cnpj(value: Column) -> Column:
    """Fourteen digits with both check digits right; a number with letters has none and is accepted."""
    d = F.regexp_replace(value, r"\D", "")
    right = (d.substr(13, 1).try_cast("int") == _check(d, CNPJ_WEIGHTS[1:])) & (d.substr(14, 1).try_cast("int") == _check(d, CNPJ_WEIGHTS))
    return F.when(value.rlike("[A-Za-z]"), F.lit(True)).when((F.length(d) == 14) & ~d.rlike(r"^(\d)\1*$"), right).otherwise(F.lit(False))


def entities(text: Column) -> dict[str, Column]:
    """Lists by kind, all in one projection over the text."""
    out = {"emails": found(text, MASKS["email"]), "ips": F.slice(F.array_distinct(F.concat(mask(text, "ipv4"), mask(text, "ipv6"))), 1, 30)}
    out["cpfs"] = F.slice(F.filter(F.array_distinct(mask(text, "cpf")), valid_cpf), 1, 30)
    out["cnpjs"] = F.slice(F.filter(F.array_distinct(mask(text, "cnpj")), valid_cnpj), 1, 30)
    out["urls"] = F.slice(F.array_distinct(F.transform(mask(text, "url"), lambda u: F.regexp_replace(u, "[.,;:)\"']+$", ""))), 1, 30)
    out["domains"] = domains(text, out["emails"], out["urls"])
    out["rgs"] = found(text, RG, group=1)
    pair = lambda c, i: F.regexp_extract(c, COORDINATES, i)
    inside = F.filter(found(text, COORDINATES, 1 << 20), lambda c: (F.abs(pair(c, 1).try_cast("double")) <= 90) & (F.abs(pair(c, 2).try_cast("double")) <= 180))
    out["coordenadas"] = F.slice(F.array_distinct(F.transform(inside, lambda c: F.concat_ws(", ", pair(c, 1), pair(c, 2)))), 1, 30)
    return out | {k: found(text, p) for k, p in ENTITIES.items()}


def valid_domain(value: Column) -> Column:
    """4 to 253 characters, two to five labels without hyphens at their ends, and a root, the first label but for "www", that isn't
    a common word, has three characters (four before an uncommon ending) and at most two hyphens; no label between them has a
    hyphen and digits."""
    d = F.lower(F.trim(value))

    def judged(labels: Column) -> Column:
        first = F.when((F.get(labels, 0) == "www") & (F.size(labels) >= 3), F.lit(1)).otherwise(F.lit(0))
        root = F.get(labels, first)
        between = F.slice(labels, first + 2, F.greatest(F.size(labels) - first - 2, F.lit(0)))
        least = F.when(F.element_at(labels, -1).isin(COMMON_TLDS), F.lit(3)).otherwise(F.lit(4))
        return (
            F.size(labels).between(2, 5)
            & F.forall(labels, lambda v: (v != "") & ~v.rlike("^-|-$"))
            & ~root.isin(WORD_ROOTS)
            & (F.length(root) >= least)
            & (F.length(root) - F.length(F.replace(root, F.lit("-"), F.lit(""))) <= 2)
            & ~F.exists(between, lambda v: v.contains("-") & v.rlike(r"\d"))
        )

    return F.length(d).between(4, 253) & let(F.split(d, r"\."), judged)


def domains(text: Column, emails: Column, urls: Column) -> Column:
    """Valid domains that are no part of the e-mails or links found; a first label that is a damaged "www" is repaired."""
    alone = F.filter(F.regexp_extract_all(text, F.lit("(?U)" + DOMAIN), F.lit(0)), lambda d: ~F.array_contains(emails, d) & ~F.exists(urls, lambda u: u.contains(d)))
    rest = lambda d: F.regexp_replace(d, r"^[^.]*\.", "")
    repaired = F.transform(alone, lambda d: F.when(F.get(F.split(d, r"\."), 0).rlike(DAMAGED_WWW), F.concat(F.lit("www."), rest(d))).otherwise(d))
    return F.slice(F.array_distinct(F.filter(repaired, valid_domain)), 1, 30)


def money(text: Column) -> Column:
    """array of (currency, value_str), currency by currency, distinct, at most 20."""
    one = lambda c: F.transform(F.filter(found(text, MONEY[c], 1 << 20), lambda v: v.rlike(r"\d")), lambda v: F.struct(F.lit(c).alias("currency"), v.alias("value_str")))
    return F.slice(F.concat(*[one(c) for c in MONEY]), 1, 20)


def parties(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(rf"(?imu)^[\s]*(?:{PARTY_LABELS})\b[:\s]*([^\n]{{3,80}})"), F.lit(1))
    named = F.transform(raw, lambda p: F.substring(F.regexp_replace(F.trim(p), r"\s+", " "), 1, 100))
    return F.slice(F.array_distinct(F.filter(named, lambda p: F.length(p) > 2)), 1, 15)


def party_type(name: Column) -> Column:
    """org, or person where no word of an organisation occurs and there are two words or more."""
    n = F.lower(name)
    org = F.lit(False)
    for w in ORGANISATION:
        org = org | n.contains(w)
    return F.when(org, F.lit("org")).when(F.size(F.split(F.trim(n), r"\s+")) >= 2, F.lit("person")).otherwise(F.lit("org"))


def tags(doc_type: Column, text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 6000))
    hit = [F.when(F.greatest(*[head.contains(w) for w in ws]) if len(ws) > 1 else head.contains(ws[0]), F.lit(t)) for t, ws in TAGS.items()]
    own = F.when(doc_type != "documento", doc_type)
    return F.slice(F.array_distinct(F.filter(F.array(own, *hit), lambda t: t.isNotNull() & (t != ""))), 1, 10)


def confidentiality(text: Column) -> Column:
    """The most restrictive level whose stamp begins a line or follows a label; null in released documents."""
    head = F.substring(text, 1, 30_000)
    before = {k: LINE_OR_CLASS if k in WITHOUT_LABEL else f"{LINE_OR_CLASS}|{SECRECY_LABEL}" for k in LEVELS}
    level = F.coalesce(*[F.when(head.rlike(f"(?imuU)(?:{before[k]})(?:{p})\\b"), F.lit(k)) for k, p in LEVELS.items()])
    return F.when(~head.rlike(f"(?i){RELEASED}"), level)
