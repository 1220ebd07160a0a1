"""Formulas in text: LaTeX spans and runs of mathematical symbols, their LaTeX form and a Markdown section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import let, strip

# Mathematical characters and their macros.
LATEX = {
    "∫": "\\int ", "∮": "\\oint ", "∯": "\\oiint ", "∑": "\\sum ", "∏": "\\prod ", "∐": "\\coprod ", "√": "\\sqrt ", "∂": "\\partial ", "∇": "\\nabla ", "∞": "\\infty ",
    "±": "\\pm ", "×": "\\times ", "÷": "\\div ", "≤": "\\le ", "≥": "\\ge ", "≠": "\\ne ", "≈": "\\approx ", "≡": "\\equiv ", "≅": "\\cong ", "∼": "\\sim ", "∝": "\\propto ",
    "∈": "\\in ", "∉": "\\notin ", "∋": "\\ni ", "⊂": "\\subset ", "⊃": "\\supset ", "⊆": "\\subseteq ", "⊇": "\\supseteq ", "∪": "\\cup ", "∩": "\\cap ", "∧": "\\wedge ", "∨": "\\vee ", "¬": "\\neg ",
    "→": "\\to ", "←": "\\gets ", "↔": "\\leftrightarrow ", "⇒": "\\Rightarrow ", "⇐": "\\Leftarrow ", "⇔": "\\Leftrightarrow ", "°": "^{\\circ}", "′": "'", "″": "''",
    "α": "\\alpha ", "β": "\\beta ", "γ": "\\gamma ", "δ": "\\delta ", "ε": "\\varepsilon ", "ζ": "\\zeta ", "η": "\\eta ", "θ": "\\theta ", "ι": "\\iota ", "κ": "\\kappa ", "λ": "\\lambda ", "μ": "\\mu ",
    "ν": "\\nu ", "ξ": "\\xi ", "ο": "o", "π": "\\pi ", "ρ": "\\rho ", "σ": "\\sigma ", "τ": "\\tau ", "υ": "\\upsilon ", "φ": "\\varphi ", "χ": "\\chi ", "ψ": "\\psi ", "ω": "\\omega ",
    "Γ": "\\Gamma ", "Δ": "\\Delta ", "Θ": "\\Theta ", "Λ": "\\Lambda ", "Ξ": "\\Xi ", "Π": "\\Pi ", "Σ": "\\Sigma ", "Φ": "\\Phi ", "Ψ": "\\Psi ", "Ω": "\\Omega ",
}
# Patterns, the body's group, and the kind, in the order in which hits are listed; limits of symbol runs.
SPANS = [
    (r"(?s)\\begin\{(equation\*?|align\*?|gather\*?|eqnarray\*?|math|displaymath)\}(.+?)\\end\{\1\}", 2, "environment"),
    (r"(?s)\$\$(.+?)\$\$", 1, "display"),
    (r"(?s)\\\[(.+?)\\\]", 1, "display"),
    (r"(?<!\$)\$(?!\$)([^$\n]{2,200}?)(?<!\$)\$(?!\$)", 1, "inline"),
]
SYMBOLS = "".join(LATEX)
NEARBY = r"A-Za-z0-9_(),.\s=+\-*/^"
LEAST_SHARE, LEAST_CHARS, MOST_HITS = 0.08, 4, 500

#: A run begins where its characters begin or where the last run ended: no other start can match, so long prose costs one pass.
RUN = rf"(?U)(?:\G|(?<![{NEARBY}]))[{NEARBY}]*+[{SYMBOLS}][{NEARBY}{SYMBOLS}]{{0,120}}"


def latex(text: Column) -> Column:
    """Each symbol as its macro, runs of blanks to one, ends stripped."""
    macros = F.create_map(*[F.lit(x) for pair in LATEX.items() for x in pair])
    swapped = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(macros[c], c)), "")
    return strip(F.regexp_replace(swapped, " {2,}", " "))


def hits(text: Column) -> Column:
    """array of (raw, kind, latex): environments, displays and inline spans, then runs of symbols, each in order of place.

    Inline spans that look like prices or prose are none. A symbol run counts once, upper and lower case alike. Null: none."""
    out = []
    for pattern, group, kind in SPANS:
        hit = lambda r: F.struct(r.alias("raw"), F.lit(kind).alias("kind"), strip(F.regexp_extract(r, pattern, group)).alias("latex"))  # noqa: B023, E731
        made = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), hit)
        if kind == "inline":
            maths = lambda b: b.rlike(rf"[=^_\\+\-*/]|\d[a-zA-Z]|[a-zA-Z]\d|[{SYMBOLS}]")
            made = F.filter(made, lambda h: ~h["latex"].rlike(r"^[\d.,\-\s]+$") & ((F.length(h["latex"]) - F.length(F.replace(h["latex"], F.lit(" "), F.lit(""))) < 3) | maths(h["latex"])))
        out.append(F.filter(made, lambda h: h["latex"] != ""))
    runs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), strip), lambda c: (F.length(c) >= LEAST_CHARS) & (F.length(F.regexp_replace(c, f"[^{SYMBOLS}]", "")) >= LEAST_SHARE * F.length(c)))
    once = let(runs, lambda r: let(F.transform(r, F.lower), lambda low: F.filter(r, lambda c, i: F.array_position(low, F.lower(c)) == i + 1)))
    symbolic = F.transform(once, lambda c: F.struct(c.alias("raw"), F.lit("unicode_heuristic").alias("kind"), latex(c).alias("latex")))
    return F.coalesce(F.concat(*out, symbolic), F.array().cast("array<struct<raw:string,kind:string,latex:string>>"))


def page_hits(pages: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """file_id, nth, page, raw, kind, latex: a document's first `most` hits by page and place, that limit being the feature."""
    found = pages.select("file_id", "page", F.posexplode(hits(F.col("text"))).alias("pos", "h"))
    order = Window.partitionBy("file_id").orderBy("page", "pos")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("file_id", "nth", "page", "h.*")


def counts(found: DataFrame) -> DataFrame:
    """file_id, kind, n of page_hits."""
    return found.groupBy("file_id", "kind").agg(F.count("*").alias("n"))


def markdown(found: DataFrame, shown: int = 50) -> DataFrame:
    """file_id, section: a Markdown list of the first hits of page_hits; documents without hits have none."""
    per = found.groupBy("file_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "page", "kind", "latex")))).alias("h"), F.array_sort(F.collect_list("kind")).alias("k"))
    kinds = F.array_join(F.transform(F.array_distinct("k"), lambda k: F.concat(k, F.lit(": "), F.size(F.filter("k", lambda x: x == k)).cast("string"))), ", ")
    items = F.transform("h", lambda h: F.concat(F.lit("- Página "), h["page"].cast("string"), F.lit(" ("), h["kind"], F.lit("):\n\n  $$ "), h["latex"], F.lit(" $$\n")))
    more = F.when(F.col("total") > shown, F.concat(F.lit("_…e mais "), (F.col("total") - shown).cast("string"), F.lit(" fórmulas omitidas._")))
    head = F.concat(F.lit("## Fórmulas detectadas\n\nTotal: **"), F.col("total").cast("string"), F.lit("** (\n"), kinds, F.lit("\n)\n"))
    return per.select("file_id", F.concat_ws("\n", head, F.array_join(items, "\n"), more).alias("section"))
