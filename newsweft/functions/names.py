"""Columns over company names: the issuer behind a security, its brand, the terms that identify it, and hosts that bear it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a security's name adds to its issuer's, anywhere, and at the end only.
SECURITY_MARKERS = (
    "class a common stock", "class b common stock", "class c common stock", "class a ordinary shares", "class b ordinary shares", "class c ordinary shares",
    "american depositary shares", "american depositary share", "american depository shares", "american depository share", "new york registry shares",
    "ordinary shares", "common shares", "common share", "new common stock", "common stock", "capital stock", "depositary shares", "depositary receipts",
    "common units", "tangible equity units", "tangible equity unit", "warrants", "warrant", "units",
)
SECURITY_ENDINGS = ("corporate units", "dep shr srs a pfd", "preferred shares", "preferred share", "preferred stock", "preference shares", "preference share", "rights", "unit")
JURISDICTIONS = ("canada", "de", "delaware", "ireland", "md", "tx")
# Words that are no part of an identity, of a brand, or that tell nothing apart.
NAME_STOP_WORDS = (
    "ag", "and", "class", "co", "common", "company", "corp", "corporation", "group", "holding", "holdings", "inc", "incorporated", "international", "limited", "llc", "lp", "ltd", "motor", "nv",
    "ordinary", "of", "plc", "reit", "sa", "se", "share", "shares", "stock", "systems", "technologies", "technology", "the",
)
BRAND_STOP_WORDS = ("ag", "and", "co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "lp", "ltd", "nv", "plc", "railroad", "railway", "reit", "sa", "se", "the")
ANNOTATION_WORDS = (
    "aka", "brand", "dba", "due", "fka", "formerly", "in", "incorporating", "informally", "known", "maker", "makers", "name", "named", "prev", "previous", "previously", "process", "product",
    "pronounced", "renamed", "tbd", "to", "trademark", "was",
)
GENERIC_WORDS = (
    "advanced", "bio", "biopharma", "capital", "digital", "energy", "financial", "global", "health", "industries", "media", "medical", "new", "pharma", "pharmaceutical", "pharmaceuticals",
    "resources", "services", "solutions", "therapeutics",
)
SPELT_FORMS = ("p l c", "l l c", "s a", "n v")
RECEIPT_WORDS = ("adr", "adrs", "ads", "gdr", "gdrs", "receipt", "receipts")
#: Legal words with the letter and the short form that they add to an acronym.
LEGAL_FORMS = (("co", "co"), ("company", "co"), ("corp", "corp"), ("corporation", "corp"), ("inc", "inc"), ("incorporated", "inc"), ("limited", "ltd"), ("ltd", "ltd"), ("plc", "plc"))
HOST_ENDINGS = ("bank", "bio", "capital", "corp", "group", "health", "holdings", "labs", "online", "properties", "systems", "tech", "trucks")
HOST_BEGINNINGS = ("get", "go", "join", "my", "try", "use")
VEHICLE_CLASS_WORDS = (
    "angel", "blackrock", "blackstone", "common", "corp", "corporation", "fund", "funds", "gabelli", "inc", "incorporated", "interest", "invesco", "limited", "ltd", "mfs", "oak", "royce", "shares",
    "sprott", "stock", "trust",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def listed(words: tuple[str, ...]) -> Column:
    """An array of the words, parsed in one step: a literal for each would be a call to the JVM for each."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def _among(word: Column, words: tuple[str, ...]) -> Column:
    return F.array_contains(listed(words), word)


def words(text: Column) -> Column:
    """The runs of ASCII letters and digits, in lower case and order."""
    return F.filter(F.transform(F.split(text, "[^A-Za-z0-9]+"), F.lower), lambda w: w != "")


_MARK = rf"(?is) (?:{'|'.join(SECURITY_MARKERS)}|(?:{'|'.join(SECURITY_ENDINGS)})$)"
#: The last word "class" or "series" with a token of at most four letters and at most six words more.
_CLASS = r"(?i)(?:^|(?<= ))(?:class|series) [^a-z0-9 ]*[a-z0-9]{1,4}[^a-z0-9 ]*(?: (?!(?:class|series)(?: |$))[^ ]+){0,6}$"


def security_name(name: Column) -> Column:
    """The issuer's name: cut before the first security marker, then without a short class and a jurisdiction in brackets."""

    def without_class(cut: Column) -> Column:
        return let(F.trim(F.regexp_replace(cut, r"\s+", " ")), lambda once: F.when(once.rlike(_CLASS), F.trim(F.regexp_replace(once, _CLASS, ""))).otherwise(cut))

    def issuer(bare: Column) -> Column:
        cut = F.regexp_replace(F.regexp_extract(bare, _MARK.replace("(?is)", "(?is)^(.*?)"), 1), r"[\s,:;-]+$", "")
        short = F.regexp_replace(let(cut, without_class), rf"(?i)\s+\((?:{'|'.join(JURISDICTIONS)})\)$", "")
        return F.when(bare.rlike(_MARK), F.coalesce(F.nullif(short, F.lit("")), bare)).otherwise(bare)

    return let(F.trim(name), issuer)


def identity_words(name: Column) -> Column:
    return F.filter(words(name), lambda w: (F.length(w) >= 2) & ~_among(w, NAME_STOP_WORDS))


def brand_tokens(name: Column) -> Column:
    """The words of the issuer's name without legal forms and connectors, nor a legal form spelt letter by letter at the end."""

    def spelt(text: Column) -> Column:
        return reduce(lambda rest, form: F.when((text == form) | F.endswith(text, F.lit(" " + form)), F.lit(len(form.split()))).otherwise(rest), reversed(SPELT_FORMS), F.lit(0))

    found = F.filter(words(security_name(name)), lambda w: ~_among(w, BRAND_STOP_WORDS))
    return let(found, lambda f: F.slice(f, F.lit(1), F.size(f) - let(F.array_join(f, " "), spelt)))


def _initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda w: F.substring(w, 1, 1)), "")


def acronym(tokens: Column) -> Column:
    """The first letters of three tokens or more, else null."""
    return F.when(F.size(tokens) >= 3, _initials(tokens))


def legal_acronyms(name: Column, tokens: Column) -> Column:
    """The first letters of two tokens or more with the first legal form that the name has, by its letter and in short."""
    legal = F.get(F.filter(words(name), lambda w: _among(w, tuple(k for k, _ in LEGAL_FORMS))), F.lit(0))
    short = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in LEGAL_FORMS) + ")"), legal)

    def both(base: Column) -> Column:
        return let(short, lambda x: F.when(x.isNotNull(), F.filter(F.array(F.concat(base, F.substring(x, 1, 1)), F.concat(base, x)), lambda a: F.length(a) >= 3)))

    return F.coalesce(F.when(F.size(tokens) >= 2, let(_initials(tokens), both)), F.array().cast("array<string>"))


def scope_terms(names: Column) -> Column:
    """The distinct terms that identify a company of these names: distinctive words, acronyms, and acronyms with a legal form."""

    def of(bare: Column) -> Column:
        telling = F.filter(identity_words(bare), lambda w: ~_among(w, GENERIC_WORDS + ANNOTATION_WORDS) & ((F.length(w) >= 3) | w.rlike("[0-9]")))
        told = F.filter(brand_tokens(bare), lambda w: ~_among(w, ANNOTATION_WORDS))
        return let(told, lambda brand: F.concat(telling, F.array_compact(F.array(acronym(brand))), legal_acronyms(bare, brand)))

    return F.array_distinct(F.flatten(F.transform(F.array_compact(names), lambda n: let(security_name(n), of))))


def issuer_key(name: Column) -> Column:
    """Letters and digits of the issuer's name in lower case."""
    return F.regexp_replace(F.lower(security_name(name)), r"[^\p{L}\p{N}]", "")


def issuer_tokens(name: Column) -> Column:
    """The brand without receipt words at its end, space-joined; null without any."""
    text = F.regexp_replace(F.array_join(brand_tokens(name), " "), rf"( ?\b({'|'.join(RECEIPT_WORDS)}))+$", "")
    return F.nullif(text, F.lit(""))


def is_vehicle(name: Column) -> Column:
    """A trust or fund, which its manager's host does not identify."""
    return let(F.lower(security_name(name)), lambda bare: bare.contains("shares of beneficial interest") | F.arrays_overlap(words(bare), listed(("trust", "fund"))))


def mentions_term(tokens: Column, terms: Column, least: int = 1) -> Column:
    """Some token is a term of ``least`` letters or more, or both have five and one begins with the other, three letters longer at most."""
    near = lambda t, w: (F.abs(F.length(t) - F.length(w)) <= 3) & (F.startswith(t, w) | F.startswith(w, t))
    prefix = F.exists(tokens, lambda t: (F.length(t) >= 5) & F.exists(terms, lambda w: (F.length(w) >= 5) & near(t, w)))
    return F.coalesce(F.arrays_overlap(tokens, F.filter(terms, lambda w: F.length(w) >= least)), F.lit(False)) | F.coalesce(prefix, F.lit(False))


def mentions_vehicle(tokens: Column, names: Column) -> Column:
    """The first identity word of a name, one that is no manager's or class's, and two of its words (three of four or more) are among the tokens."""

    def judged(once: Column, hits: Column) -> Column:
        enough = F.size(hits) >= F.when(F.size(once) >= 4, 3).otherwise(2)
        return (F.size(once) >= 2) & F.array_contains(tokens, F.get(once, F.lit(0))) & enough & F.exists(hits, lambda w: ~_among(w, VEHICLE_CLASS_WORDS))

    def of(name: Column) -> Column:
        once = let(identity_words(security_name(name)), lambda found: F.filter(found, lambda w, i: (i == 0) | (w != F.get(found, i - 1))))
        return let(once, lambda o: let(F.filter(o, lambda w: F.array_contains(tokens, w)), lambda hits: judged(o, hits)))

    return F.coalesce(F.exists(F.array_compact(names), of), F.lit(False))


def host_labels(host: Column) -> Column:
    """Letters and digits of the host's labels, without the last of several."""
    found = F.filter(F.transform(F.split(F.lower(host), r"\."), lambda x: F.regexp_replace(x, "[^a-z0-9]", "")), lambda x: x != "")
    return let(found, lambda f: F.when(F.size(f) > 1, F.slice(f, F.lit(1), F.size(f) - 1)).otherwise(f))


def host_suffixes(host: Column) -> Column:
    """The host and every host above it: what it may be listed under."""
    return let(F.split(host, r"\."), lambda labels: F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def short_acronyms(names: Column) -> Column:
    """Two letters of brands with two tokens; they count only where a host bears them too."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.array_compact(names), brand_tokens), lambda t: F.size(t) == 2), _initials))


def host_forms(name: Column) -> Column:
    """What a host label may show of a name: (whole labels, beginnings or ends of labels, short brands with a usual affix)."""

    def forms(found: Column, brand: Column) -> Column:
        compact, first = F.array_join(found, ""), F.get(brand, F.lit(0))
        banked = F.array_join(F.transform(found, lambda w: F.when(w == "bancorp", "bank").otherwise(w)), "")
        searched = F.regexp_replace(F.lower(security_name(name)), "[^a-z0-9]", "")
        bank = let(searched, lambda s: F.when(F.endswith(s, F.lit("bancorp")), F.regexp_replace(s, "bancorp$", "bank")))
        led = F.when((F.size(brand) >= 3) & (F.length(first) >= 4), F.concat(first, _initials(F.slice(brand, F.lit(2), F.size(brand)))))
        whole = F.concat(F.filter(F.concat(F.array(compact), found), lambda w: F.length(w) >= 3), legal_acronyms(name, brand), F.array_compact(F.array(acronym(brand), led)))
        ends = F.filter(F.array_compact(F.array(compact, banked, bank)), lambda w: F.length(w) >= 5)
        short = F.filter(F.array_compact(F.array(compact, acronym(brand), first)), lambda w: F.length(w).between(3, 4))
        return F.struct(F.array_distinct(whole).alias("whole"), F.array_distinct(ends).alias("ends"), F.array_distinct(short).alias("short"))

    return let(identity_words(name), lambda found: let(brand_tokens(name), lambda brand: forms(found, brand)))


def labels_match(labels: Column, forms: Column) -> Column:
    """Whether host labels show a name, as ``host_forms`` has it."""
    affixed = lambda x: F.concat(F.transform(listed(HOST_ENDINGS), lambda e: F.concat(x, e)), F.transform(listed(HOST_BEGINNINGS), lambda b: F.concat(b, x)))
    at_an_end = F.exists(forms["ends"], lambda x: F.exists(labels, lambda l: F.startswith(l, x) | F.endswith(l, x)))
    return F.arrays_overlap(labels, forms["whole"]) | at_an_end | F.exists(forms["short"], lambda x: F.arrays_overlap(labels, affixed(x)))


def name_matches_host(name: Column, host: Column) -> Column:
    """The host bears the company's name: its words together, its brand's acronyms, a short brand with a usual affix, or one word of three letters."""
    return let(host_labels(host), lambda labels: let(host_forms(name), lambda forms: F.coalesce(labels_match(labels, forms), F.lit(False))))
