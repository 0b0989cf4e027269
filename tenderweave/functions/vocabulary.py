"""Rule tables over titles and texts, and the column functions that apply them.

A rule is (label, terms): it fits a text that contains one of the terms, case apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases, thesaurus
from .text import classify_first, labels_of

# Labels and their terms, in their order of precedence.
CATEGORIES6 = [
    ("lighting", ["lighting", "led", "luminaire", "lamp"]),
    ("electrical cable", ["cable", "wire"]),
    ("transformer", ["transformer"]),
    ("motor", ["motor", "rotating electrical machine"]),
    ("switchgear", ["switchgear", "controlgear"]),
    ("appliance", ["household", "appliance", "refrigerator", "oven", "heater"]),
]
TYPES = [
    ("Testing Method", ["test", "determination", "measurement", "method"]),
    ("Safety", ["safety"]),
    ("Performance", ["performance"]),
    ("Installation", ["installation"]),
    ("Design", ["design"]),
    ("Terminology", ["vocabulary", "terminology", "definitions"]),
    ("Application Guide", ["guide", "practice"]),
    ("Maintenance", ["maintenance"]),
    ("Product Specification", ["specification", "requirements"]),
]
TYPES_DETAILED = [
    ("Safety", ["safety requirement", "safe use", "safety standard", "safety of household", "safety of machinery"]),
    ("Testing", ["test method", "methods of test", "method of measurement", "testing of", "measurement of"]),
    ("Code of Practice", ["code of practice", "installation guide", "guide for", "handbook", "recommended practice"]),
    ("Glossary", ["glossary", "terminology", "vocabulary", "definition", "terms and definitions"]),
    ("Symbols & Markings", ["graphical symbol", "symbols for", "marking", "designation of", "classification of"]),
    ("Installation", ["installation", "wiring", "erection"]),
]
CATEGORIES9 = [
    ("Lighting & LED", ["lighting", "led", "luminaire", "lamp", "street light", "flood light"]),
    ("Electrical Installation & Safety", ["installation", "wiring", "safety", "circuit breaker", "earthing", "switchgear"]),
    ("Motors & Rotating Machines", ["motor", "rotating electrical machine", "generator", "turbine"]),
    ("Cables & Wires", ["cable", "wire", "conductor"]),
    ("Transformers", ["transformer", "inductor"]),
    ("Batteries & Energy Storage", ["battery", "batteries", "energy storage", "lithium-ion", "accumulator"]),
    ("Medical Electrical Equipment", ["medical electrical", "hospital", "x-ray", "incubator", "surgical"]),
    ("Renewable Energy & EV", ["solar", "photovoltaic", "electric vehicle", "ev supply", "electric power train"]),
    ("Testing & Measurement", ["measurement", "testing", "meter", "instrument"]),
]
KEYWORDS = [("LED", ["led"]), ("street lighting", ["street"]), ("electric motor", ["motor"]), ("electrical cable", ["cable"]), ("transformer", ["transformer"])]
CONTEXTS = [
    ("marine naval offshore shipboard", ["ship", "marine", "vessel", "offshore"]),
    ("aircraft aerospace aviation", ["aircraft", "aerospace", "avionics"]),
    ("mine mining underground hazardous area", ["mine", "mining", "coal", "underground mine"]),
    ("railway rail traction metro transit", ["railway", "rail", "metro", "traction"]),
    ("hospital medical healthcare clinical", ["hospital", "medical", "clinic", "patient"]),
    ("industrial factory plant manufacturing process", ["industrial", "factory", "plant", "process"]),
    ("domestic residential home consumer", ["domestic", "household", "home", "residential"]),
    ("outdoor municipal infrastructure road highway", ["outdoor", "street", "road", "highway", "municipal"]),
    ("hazardous area explosive atmosphere Zone 1 Zone 2 ATEX", ["hazardous", "explosive atmosphere", "flameproof", "atex"]),
]
DOMAINS = [
    ("medical electrical equipment", ["medical", "clinical", "patient", "surgical", "hospital"]),
    ("LED street lighting luminaires", ["led street", "led road", "street light", "road lighting", "street lighting"]),
    ("luminaires and lighting equipment", ["luminari", "luminaire", "lighting fixture", "light fitting"]),
    ("lamp controlgear and control devices", ["lamp control", "controlgear", "ballast", "led driver", "driver"]),
    ("electrical wiring installations", ["electrical wiring", "wiring installation", "wiring system", "cable installation"]),
    ("national electrical installations and systems", ["national electrical code", "electrical code", "nec"]),
    ("structural steel products", ["steel", "structural steel", "hot rolled", "cold formed"]),
    ("pipes and pipe fittings for water supply", ["pipe", "tube", "plumbing", "water supply"]),
    ("electrical cables and wires", ["cable", "wire", "conductor", "insulated"]),
    ("threaded fasteners and bolted connections", ["fastener", "bolt", "nut", "screw", "washer"]),
    ("cement and concrete products", ["cement", "concrete", "mortar", "aggregate"]),
]
REFERENCES = {
    "IS 732": ["SP 30", "IS 3043", "IS 694"],
    "IS 13450 : Part 1": ["IEC 60601-1", "IS 13450 : Part 1-2", "IS 1778"],
    "IS 15885": ["IS 16107", "IEC 61347-1", "IS 10322"],
    "IS 10322": ["IS 15885", "IS 16107", "IEC 60598-1"],
    "IS 16107 : Part 2 : Sec 2": ["IS 10322", "IS 15885", "IEC 62722-2-1"],
    "SP 30": ["IS 732", "IS 3043", "IS 1646"],
}
REQUIREMENT_CATEGORIES = [
    ("certification", ["bis certification", "isi mark", "isi marked", "cm/l", "r-number", "hallmarking", "huid", "certifi", "licence", "license", r"\bbom\b", "bureau of indian standards", "bis registered", r"\bcrs\b"]),
    ("testing", ["type test", "factory acceptance test", "routine test", "test report", "testing certificate", "third party test", "acceptance test", "test at site", "commissioning test"]),
    ("safety", ["ip65", "ip66", "ip54", r"\bip\d+\b", "iec 60598", "iec 60529", "iec ", "earthing", "grounding", "short circuit", "fire rating", "flame retardant", "self-extinguishing", "protective earth", "double insulated", "class ii"]),
    ("performance", ["luminous efficacy", "lumen output", "colour rendering", r"\bcri\b", "correlated colour", r"\bcct\b", "power factor", "total harmonic distortion", r"\bthd\b", r"\bwatt\b", r"\blux\b", "illuminance", "efficiency", "rated output", r"\bflux\b"]),
    ("material", ["material ", "die cast", "aluminium", "aluminum", "stainless steel", "galvanised", "galvanized", "polycarbonate", "glass", "copper conductor", "acsr", "pvc insulated"]),
    ("installation", ["installation", "mounting", "fixing", "commissioning", "erection", "civil work", "cable laying", "pulling"]),
    ("eligibility", ["experience", "annual turnover", "registered", "empanelled", r"\boem\b", "authorized", "authorised", "manufacturer", "years of experience"]),
    ("technical_specification", ["is 10322", "is 1180", "is 694", "as per is", "conform to is", "comply with is", "as per standard", "shall conform", "technical specification", "specification", "standard"]),
]
# End of the fixed values.


def categories(title: Column, rules: list[tuple[str, list[str]]] = CATEGORIES6, default: str | None = None) -> Column:
    """All labels that fit, in the order of the rules; else the default alone, where there is one."""
    found = F.array_distinct(labels_of(title, rules))
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def top_categories(title: Column, number: Column, rules: list[tuple[str, list[str]]], most: int = 3, default: str = "General Standards") -> Column:
    """The first labels that fit title or number."""
    return F.slice(categories(F.concat_ws(" ", title, number), rules, default), 1, most)


def standard_type(title: Column, rules: list[tuple[str, list[str]]] = TYPES, default: str | None = None) -> Column:
    """The first label that fits; the default, or null, without one."""
    found = classify_first(title, rules, "")
    return F.when(found != "", found).otherwise(F.lit(default))


def keywords(title: Column, known: Column, found: Column) -> Column:
    """Known keywords, the categories found and the keywords that the title tells, sorted."""
    return F.array_sort(F.array_distinct(F.concat(known, found, labels_of(title, KEYWORDS))))


def thesaurus_terms(title: Column) -> Column:
    """The thesaurus terms of a title; thesaurus rows of equal terms count once."""
    return phrases.expanded(title, thesaurus.THESAURUS)


def categories_of_rules(title: Column, number: Column, most: int = 3) -> Column:
    """The first `most` categories of the ordered rules that a title and number fit, else General Standards."""
    found = phrases.rules_in(F.concat_ws(" ", title, number), thesaurus.CATEGORY_RULES)
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(F.lit("General Standards")))


def application_context(title: Column) -> Column:
    return F.array_join(labels_of(title, CONTEXTS), " ")


def inferred_scope(title: Column) -> Column:
    """struct(scope, generated): a sentence on the first domain that fits, else on the title itself."""
    domain = classify_first(title, DOMAINS, "")
    about = F.when(domain != "", domain).otherwise(F.rtrim(F.lower(title), F.lit(".")))
    return F.struct(F.concat(F.lit("This standard specifies requirements for "), about, F.lit(".")).alias("scope"), F.lit(True).alias("generated"))


def inferred_references(number: Column, references: Column) -> Column:
    """The references of a standard; empty lists are filled from REFERENCES."""
    table = F.create_map(*[x for k, v in REFERENCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.when(F.size(F.coalesce(references, F.array())) > 0, references).otherwise(F.coalesce(table[number], F.array().cast("array<string>")))


def synthesised_scope(title: Column, found: Column) -> Column:
    """A sentence from the title without its last part or section, and its categories."""
    base = F.trim(F.regexp_replace(title, r"(?i)\s*[:-]\s*Part \d+[\w\s]*$", ""))
    base = F.trim(F.regexp_replace(base, r"(?i)\s*[:-]\s*Section \d+[\w\s]*$", ""))
    where = F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("General")
    return F.when(F.lower(base) == F.lower(title), F.concat(title, F.lit(". Applicable to "), where, F.lit(" applications."))).otherwise(F.concat(base, F.lit(" — covers requirements for "), where, F.lit(" applications.")))


def requirement_category(text: Column, reference: Column) -> Column:
    """The first category one of whose terms or patterns occurs; a citation alone makes a technical specification."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F
    for label, terms in REQUIREMENT_CATEGORIES:
        hit = low.rlike("|".join(t if "\\" in t else t.replace("/", "\\/") for t in terms))
        out = out.when(hit, label)
    return out.when(F.coalesce(reference, F.lit("")) != "", "technical_specification").otherwise("other")


def category_of_lower(low: Column, reference: Column) -> Column:
    """requirement_category() of a text already in lower case, a column of its own as each term reads it: plain terms are
    looked for as they are, a pattern is tried only where its word stands."""
    out = F
    for label, terms in REQUIREMENT_CATEGORIES:
        hit = F.exists(F.array(*[F.lit(t) for t in terms if "\\" not in t]), lambda t: F.contains(low, t))
        for t in terms:
            if "\\" in t:
                hit = hit | (F.contains(low, F.lit(t.replace(r"\b", "").replace(r"\d+", ""))) & low.rlike(t))
        out = out.when(hit, label)
    return out.when(F.coalesce(reference, F.lit("")) != "", "technical_specification").otherwise("other")


def base_designation(number: Column, part: Column, section: Column) -> Column:
    """The number with part and section in brackets, unless it names the part already."""
    inner = F.concat_ws("/", F.nullif(part, F.lit("")), F.nullif(section, F.lit("")))
    named = F.contains(F.lower(number), F.lower(part))
    return F.when((F.coalesce(part, F.lit("")) != "") & ~named, F.concat(number, F.lit(" ("), inner, F.lit(")"))).otherwise(number)


def designation(number: Column, part: Column, section: Column, year: Column, amendments: Column) -> Column:
    """Number, part and section, year, and the last of the amendments' numbers."""
    has = F.coalesce(part, F.lit("")) != ""
    inner = F.concat_ws("/", F.nullif(part, F.lit("")), F.nullif(section, F.lit("")))
    last = F.when(F.size(F.coalesce(amendments, F.array())) > 0, F.element_at(amendments, -1).cast("string"))
    return F.concat(
        number, F.when(has, F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(""), F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(":"), year.cast("string"))).otherwise(""), F.coalesce(F.concat(F.lit(" Amd."), last), F.lit(""))
    )


def completeness(number: Column, title: Column, year: Column, scope: Column, words: Column, status: Column) -> Column:
    """1 for the record itself and 1 for each field that says something."""
    said = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    return said(number) + said(title) + (F.coalesce(year, F.lit(0)) != 0).cast("int") + said(scope) + (F.size(F.coalesce(words, F.array())) > 0).cast("int") + said(status) + 1


REAL_SOURCES = ("official", "curated")


def provenance_scope(scope: Column, summary: Column, source: Column) -> Column:
    """struct(value, source_type, verified) of a scope that is JSON of that shape, plain text or null; then the
    summary stands in, as synthetic."""
    parsed = F.from_json(F.when(F.ltrim(scope).startswith("{"), scope), "value string, source_type string, verified boolean")
    real = F.struct(scope.alias("value"), F.when(source.contains("Curated"), "curated").otherwise("official").alias("source_type"), F.lit(True).alias("verified"))
    made = F.struct(F.coalesce(summary, F.lit("")).alias("value"), F.lit("synthetic").alias("source_type"), F.lit(False).alias("verified"))
    return F.when(parsed.isNotNull(), parsed).when(F.coalesce(scope, F.lit("")) != "", real).otherwise(made)


def accepted_scope(scope: Column) -> Column:
    """struct(text, availability): a scope of a real source, else none: a synthetic one restates the title."""
    text = F.nullif(F.trim(scope["value"]), F.lit(""))
    ok = text.isNotNull() & F.lower(F.trim(scope["source_type"])).isin(*REAL_SOURCES)
    return F.struct(F.when(ok, text).alias("text"), F.when(ok, "verified").otherwise("not_available").alias("availability"))


def accepted_certification(verified: Column, mandatory: Column, scheme: Column) -> Column:
    """struct(mandatory, scheme_label, availability): only verified statements that say yes or no."""
    ok = F.coalesce(verified, F.lit(False)) & mandatory.isNotNull()
    return F.struct(F.when(ok, mandatory).alias("mandatory"), F.when(ok, F.nullif(F.trim(scheme), F.lit(""))).alias("scheme_label"), F.when(ok, "verified").otherwise("not_available").alias("availability"))


def clean_list(values: Column) -> Column:
    """Trimmed, without blanks and repeats, in order; null becomes the empty list."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array()), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def scope_text(scope: Column) -> Column:
    """The text of a scope that is plain or JSON with a value; empty without one."""
    return F.coalesce(F.when(F.ltrim(scope).startswith("{"), F.get_json_object(scope, "$.value")).otherwise(scope), F.lit(""))


def candidate_text(title: Column, scope: Column, search: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (title, scope_text(scope), search)]))


def point_id(key: Column) -> Column:
    """A whole number of the first 15 hex digits of the md5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def name_uuid(namespace: str, name: Column) -> Column:
    """The UUID of version 5: sha1 of the namespace's bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16)
    return F.lower(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))
