"""Organisation and person names as Column functions.

:func:`clean_name` chains the steps in :data:`STEPS`; each step is a function of its own and can be
tested alone. All of it stays inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import BLANK, fold_accents, group, is_all, let, matches, null_if_empty, rewrite, squeeze, text

# Legal forms, states, placeholders and token lists that results depend on.
LEGAL_FORMS = (
    "INC", "INCORPORATED", "INCORPORATION", "INCORPORATE", "INCORPORAT", "INCORPORA", "INCORPOR", "INCORP", "LLC", "LCC", "LC",
    "CORP", "CORPORATION", "CORPORATIO", "CORPORATI", "CORPORAT", "CO", "COINC", "COMPANY", "LTD", "LIMITED LIABILITY", "LIMITED",
    "LP", "LLP", "LLLP", "GP", "PLLC", "PLC", "PC",
)
STATES = (
    "ALABAMA", "ALASKA", "ARIZONA", "ARKANSAS", "CALIFORNIA", "COLORADO", "CONNECTICUT", "DELAWARE", "FLORIDA", "GEORGIA", "HAWAII",
    "IDAHO", "ILLINOIS", "INDIANA", "IOWA", "KANSAS", "KENTUCKY", "LOUISIANA", "MAINE", "MARYLAND", "MASSACHUSETTS", "MICHIGAN",
    "MINNESOTA", "MISSISSIPPI", "MISSOURI", "MONTANA", "NEBRASKA", "NEVADA", "NEW HAMPSHIRE", "NEW JERSEY", "NEW MEXICO", "NEW YORK",
    "NORTH CAROLINA", "NORTH DAKOTA", "OHIO", "OKLAHOMA", "OREGON", "PENNSYLVANIA", "RHODE ISLAND", "SOUTH CAROLINA", "SOUTH DAKOTA",
    "TENNESSEE", "TEXAS", "UTAH", "VERMONT", "VIRGINIA", "WASHINGTON", "WEST VIRGINIA", "WISCONSIN", "WYOMING",
)
DESCRIPTORS = (
    "OF", "DE", "DBA", "AT", "A", "N", "GENERAL", "CONTRACTOR", "CONTRACTORS", "CONTRACTING", "CONSTRUCTION", "CONSTRUCTORS",
    "SERVICES", "SERVICE", "GROUP", "ENTERPRISES", "ENTERPRISE", "COMPANIES", "HOLDINGS", "ASSOCIATES", "INDUSTRIES",
    "SOLUTIONS", "MANAGEMENT", "BROTHERS", "BROS", "SONS", "SON", "UNITED", "NATIONAL", "AMERICAN", "USA", "TOTAL", "COMPLETE",
    "CO", "INC", "LLC", "CORP", "COMPANY", "LTD", "LP", "LLP", "GP", "PLLC", "PC",
)
GENERIC = (
    "OF", "DE", "DBA", "AT", "A", "N",
    "CONSTRUCTION", "CONSTRUCTORS", "CONTRACTING", "CONTRACTORS", "CONTRACTOR", "BUILDERS", "BUILDER", "BUILDING", "BUILD",
    "ROOFING", "ROOF", "ROOFERS", "SERVICES", "SERVICE", "GROUP", "MASONRY", "PAINTING", "PAINTERS", "FRAMING", "CONCRETE",
    "HOME", "HOMES", "PLUMBING", "GENERAL", "DEVELOPMENT", "ENTERPRISES", "ENTERPRISE", "MECHANICAL", "REMODELING", "SOLUTIONS",
    "HEATING", "DRYWALL", "SYSTEMS", "SYSTEM", "EXCAVATING", "EXCAVATION", "ELECTRIC", "ELECTRICAL", "SIDING", "CARPENTRY",
    "STEEL", "RESTORATION", "EXTERIORS", "EXTERIOR", "INTERIORS", "INTERIOR", "CUSTOM", "DESIGN", "METAL", "METALS", "WORKS",
    "AIR", "MANAGEMENT", "IMPROVEMENT", "IMPROVEMENTS", "ASSOCIATES", "COMMERCIAL", "RESIDENTIAL", "GLASS", "STUCCO",
    "MAINTENANCE", "INDUSTRIAL", "INDUSTRIES", "STONE", "SHEET", "PLASTERING", "ENGINEERING", "ERECTORS", "ENERGY",
    "CONDITIONING", "PAVING", "INSULATION", "PROPERTIES", "PROPERTY", "COMPANIES", "CRANE", "CRANES", "RIGGING", "TILE",
    "FIRE", "FLOORING", "FLOORS", "POWER", "COOLING", "WELDING", "SOLAR", "DEMOLITION", "RENOVATIONS", "RENOVATION", "WATER",
    "TECH", "REPAIR", "REPAIRS", "ENVIRONMENTAL", "HVAC", "LANDSCAPING", "LANDSCAPE", "CABINETS", "DOORS", "WINDOWS", "FENCE",
    "FENCING", "GUTTERS", "GUTTER", "SEAMLESS", "SPRINKLER", "PROTECTION", "SAFETY", "UTILITIES", "UTILITY", "PIPELINE",
    "DRILLING", "BORING", "TRUCKING", "HAULING", "GRADING", "SITE", "SITEWORK", "MARINE", "HOLDINGS", "INSTALLATION",
    "INSTALLATIONS", "BROTHERS", "BROS", "SONS", "SON", "QUALITY", "PRO", "PROS", "PROFESSIONAL", "PROFESSIONALS", "PREMIER",
    "PREMIUM", "BEST", "ALL", "ADVANCED", "SUPERIOR", "ELITE", "TOTAL", "COMPLETE", "UNITED", "NATIONAL", "AMERICAN", "USA",
    "CO", "INC", "LLC", "CORP", "COMPANY", "LTD", "LP", "LLP", "GP", "PLLC", "PC",
)
PLACE_PREFIXES = ("SAN", "SANTA", "SANTO", "ST", "SAINT", "FORT", "FT", "MOUNT", "MT", "PORT", "LOS", "LAS", "LAKE", "CAPE")
PLACEHOLDER_NAMES = "N ?A|NONE|TBD|NO NAME|TEST|NOT AVAILABLE|VARIOUS|OWNER|UNK|HOME ?OWNERS?|ROOFER|ROOFING CONTRACTOR|CONTRACTOR|SELF EMPLOYED"
PLACEHOLDER_WORDS = r"\b(UNKNOWN|UNKOWN|UNKNWN|UNIDENTIFIED)\b|INVALID ESTABLISHMENT"
AGENCY_OFFICES = r"^(US ?DOL|USDL|US DEPARTMENT OF LABOR|US DEPT OF LABOR|DEPARTMENT OF LABOR|DOL) OSHA\b|^OSHA$|^OSHA( [A-Z]+)* (AREA|DISTRICT|REGIONAL) OFFICE$|\bAREA OSHA OFFICE$"
DBA_MARKERS = r"(\S)\s*\b(?:D\s*/?\s*B\s*/?\s*A|DOING BUSINESS AS|T\s*/\s*A|TRADING AS|A\s*/?\s*K\s*/?\s*A)\b\s*"
SPELLED = (("[Ø]", "O"), ("[Ł]", "L"), ("[ĐÐ]", "D"), ("Æ", "AE"), ("Œ", "OE"), ("ẞ", "SS"), ("Þ", "TH"))
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))

_FORMS = "|".join(LEGAL_FORMS)


def upper_ascii(c: Column | str) -> Column:
    """Wide forms, ligatures and accents made plain, upper case, blanks squeezed."""
    from .text import NARROW, WIDE

    plain = rewrite(F.translate(text(c), WIDE, NARROW), *LIGATURES)
    return squeeze(rewrite(F.upper(fold_accents(plain)), *SPELLED))


def drop_record_number(c: Column) -> Column:
    """Without the case or record number that some sources put before the name."""
    case = r"^[A-Z]+[0-9][A-Z0-9]{8,}\s+-\s+"

    def drop(x: Column) -> Column:
        digits = F.length(F.regexp_replace(F.substring_index(x, " ", 1), "[^0-9]", ""))
        plain = F.regexp_replace(x, r"^[A-Z]{0,3}(?:[0-9]{5,}\s*-\s*|[0-9]{3,}\s+-\s+)", "")
        return F.when(matches(x, case) & (digits >= 4), F.regexp_replace(x, case, "")).otherwise(plain)

    return let(c, drop)


def drop_dots(c: Column) -> Column:
    return F.regexp_replace(c, "['’‘`´ʼ.]", "")


def mark_trade_name(c: Column) -> Column:
    """All ways of saying "doing business as" become `` DBA ``, unless nothing stands before."""
    return F.regexp_replace(c, DBA_MARKERS, "$1 DBA ")


def drop_state_note(c: Column) -> Column:
    return rewrite(c, (r"\(\s*JV\s*\)\s*\z", " JV"), (rf"\s*\((?:{'|'.join(STATES)}|[A-Z]{{2}})\)\s*\z", ""))


def plain_words(c: Column) -> Column:
    return squeeze(rewrite(c, ("[^A-Z0-9 ]", " "), (r"\bAND\b", " ")))


def drop_article(c: Column) -> Column:
    return rewrite(c, (r"^THE\s+", ""), (r"\s+THE\z", ""))


def join_legal_letters(c: Column) -> Column:
    return rewrite(c, (r"\bP L L C\b", "PLLC"), (r"\bL L C\b", "LLC"), (r"\bL L P\b", "LLP"), (r"(^|[A-Z0-9]{2,} )([LG]) P\b", "$1$2P"))


def drop_legal_form(c: Column) -> Column:
    """Without legal forms at the end and before DBA, unless nothing would be left."""
    bare = lambda x: F.trim(rewrite(x, (r"\s+DBA\z", ""), (rf"(?:\s+(?:{_FORMS}))+\s+DBA\b", " DBA"), (rf"(?:\s+(?:THE|{_FORMS}))+\s*\z", "")))
    return let(c, lambda x: F.coalesce(null_if_empty(bare(x)), x))


def join_initials(c: Column) -> Column:
    """``A B C ROOFING`` becomes ``ABC ROOFING``; a letter also joins a short number after it."""
    return rewrite(c, (r"(?<=(?:^| )[A-Z]) (?=[A-Z](?: |\z))", ""), (r"(^| )([A-Z]) ([0-9]{1,3})( |\z)", "$1$2$3$4"))


STEPS = (drop_record_number, drop_dots, mark_trade_name, drop_state_note, plain_words, drop_article, join_legal_letters, drop_legal_form, join_initials)


def clean_name(c: Column | str, upto: int = len(STEPS)) -> Column:
    """The comparable form of a raw name. ``upto`` stops after so many steps."""
    out = upper_ascii(c)
    for step in STEPS[:upto]:
        out = step(out)
    return squeeze(out)


def legal_part(clean: Column) -> Column:
    return F.trim(F.split_part(clean, F.lit(" DBA "), F.lit(1)))


def trade_part(clean: Column) -> Column:
    """What stands after DBA, or null."""
    return F.when(F.contains(clean, F.lit(" DBA ")), null_if_empty(F.trim(F.split_part(clean, F.lit(" DBA "), F.lit(2)))))


def is_placeholder(clean: Column) -> Column:
    c = text(clean)
    return (c == "") | matches(c, PLACEHOLDER_WORDS) | is_all(c, PLACEHOLDER_NAMES) | matches(c, AGENCY_OFFICES)


def is_joint_venture(clean: Column) -> Column:
    return matches(clean, r"\b(?:JV|JOINT VENTURE)\b")


def place_suffix(clean: Column) -> Column:
    """A trailing `` OF X`` or `` AT X``, or null."""
    return null_if_empty(group(clean, BLANK + r"(?:OF|AT)" + BLANK + r"+[A-Z0-9 ]+\z", 0))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def name_core(clean: Column) -> Column:
    """The words of the legal part that are not generic."""
    return F.coalesce(F.array_join(F.filter(_words(legal_part(clean)), lambda w: ~w.isin(*GENERIC)), " "), F.lit(""))


def initials_only(clean: Column) -> Column:
    return is_all(name_core(clean), "[A-Z]{1,3}(?: [A-Z]{1,3})*")


def is_person(core: Column, given: tuple[str, ...], surnames: tuple[str, ...]) -> Column:
    """Two to four plain words that read like a person's name by the lists of given and last names."""
    w = F.split(core, " ")
    first, second, third, n = F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.get(w, F.lit(2)), F.size(w)
    reversed_name = ~first.isin(*PLACE_PREFIXES) & second.isin(*given) & ((n == 2) | ((n == 3) & (F.length(third) == 1)))
    initial = (n == 2) & (F.length(first) == 1) & second.isin(*surnames)
    shape = n.between(2, 4) & is_all(core, "[A-Z]+(?: [A-Z]+)*")
    return F.coalesce(shape & (first.isin(*given) | reversed_name | initial), F.lit(False))
