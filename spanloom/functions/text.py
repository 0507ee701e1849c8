"""Column functions over strings: spaces, new lines, quoting, Greek letters, patterns' clean form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Twenty characters that show as a space; neither line feeds nor zero-width ones.
SPACES = r"[\t\x0B\f\r\x1C-\x1F    -   　]"

GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
#: Further characters that stand for a letter's name in text.
GREEK_VARIANTS = {"ß": "beta", "ς": "sigma", "ϐ": "beta", "ϑ": "theta", "ϕ": "phi", "ϖ": "pi", "ϰ": "kappa", "ϱ": "rho", "ϵ": "epsilon", "µ": "mu"}
GREEK_NAMES = GREEK | {k.upper(): v.capitalize() for k, v in GREEK.items()} | GREEK_VARIANTS


def normalize_spaces(c: Column) -> Column:
    """Every character that shows as a space becomes one; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def join_newlines(c: Column) -> Column:
    """Spaces normalised, none after a line feed; a single line feed becomes a space, two or more stay."""
    c = F.regexp_replace(normalize_spaces(c), "\n +", "\n")
    return F.regexp_replace(c, "(?<!\n)\n(?!\n)", " ")


def escape_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("␣"))


def flat(c: Column) -> Column:
    """Tabs and line feeds as spaces, for a field of a line."""
    return F.translate(c, "\t\n", "  ")


def quoted_property(name: Column, value: Column) -> Column:
    """name="value"; a name with a space or a quote is quoted too."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.when(name.rlike('[ "]'), q(name)).otherwise(name), F.lit("="), q(value))


def offset_string(begin: Column, end: Column) -> Column:
    return F.concat_ws(":", begin, end)


def offsets_string(spans: Column) -> Column:
    """b:e;b:e of an array of structs with begin and end."""
    return F.array_join(F.transform(spans, lambda s: offset_string(s["begin"], s["end"])), ";")


def greek_to_latin(c: Column) -> Column:
    """Each Greek letter as its name."""
    for letter, name in GREEK_NAMES.items():
        c = F.replace(c, F.lit(letter), F.lit(name))
    return c


def latin_to_greek(c: Column) -> Column:
    """Lower-case and capitalised names of Greek letters as letters, longest names first."""
    names = sorted(((v, k) for k, v in {**GREEK, **{k.upper(): v.capitalize() for k, v in GREEK.items()}}.items()), key=lambda x: (-len(x[0]), x[0]))
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(letter).alias("letter")) for name, letter in names))
    return F.aggregate(pairs, c, lambda done, p: F.replace(done, p["name"], p["letter"]))


def clean_pattern(c: Column) -> Column:
    """The text of a relation pattern without dangling punctuation."""
    c = F.regexp_replace(F.regexp_replace(c, "(?<!\n)\n(?!\n)", " "), " {2,}", " ")
    c = F.regexp_replace(F.regexp_replace(c, "(?: -)+(?= -)", ""), ",(?: ,)+", ",")
    return F.trim(F.regexp_replace(c, "(?: ?[.,])+ ?$", ""))


def base_name(uri: Column, extension: bool = True) -> Column:
    name = F.regexp_extract(uri, "([^/]+)/*$", 1)
    return name if extension else F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def compressed(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "")


def entity_string(kind: Column, namespace: Column, identifier: Column) -> Column:
    """type(namespace:id)"""
    return F.concat(kind, F.lit("("), namespace, F.lit(":"), identifier, F.lit(")"))
