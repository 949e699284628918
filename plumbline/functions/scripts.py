"""Names across scripts: the written forms of common names and the search variants that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import SCRIPTS, language_of
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

#: Languages of the written forms, in the order of the variants; only the first five have forms.
LANGUAGES = ("hi", "ta", "te", "kn", "ml", "mr", "bn", "gu", "pa")
#: Common names in the first five languages.
WRITTEN = {
    "modi": ("मोदी", "மோடி", "మోదీ", "ಮೋದಿ", "മോദി"),
    "gandhi": ("गांधी", "காந்தி", "గాంధీ", "ಗಾಂಧಿ", "ഗാന്ധി"),
    "nehru": ("नेहरू", "நேரு", "నెహ్రూ", "ನೆಹ್ರು", "നെഹ്‌റു"),
    "singh": ("सिंह", "சிங்", "సింగ్", "ಸಿಂಗ್", "സിംഗ്"),
    "kumar": ("कुमार", "குமார்", "కుమార్", "ಕುಮಾರ್", "കുമാർ"),
    "sharma": ("शर्मा", "சர்மா", "శర్మ", "ಶರ್ಮ", "ശർമ"),
    "verma": ("वर्मा", "வர்மா", "వర్మ", "ವರ್ಮ", "വർമ"),
    "patel": ("पटेल", "படேல்", "పటేల్", "ಪಟೇಲ್", "പട്ടേൽ"),
    "reddy": ("रेड्डी", "ரெட்டி", "రెడ్డి", "ರೆಡ್ಡಿ", "റെഡ്ഡി"),
    "naidu": ("नायडू", "நாயுடு", "నాయుడు", "ನಾಯ್ಡು", "നായ്ഡു"),
    "rao": ("राव", "ராவ்", "రావు", "ರಾವು", "റാവു"),
    "iyer": ("अय्यर", "ஐயர்", "అయ్యర్", "ಅಯ್ಯರ್", "അയ്യർ"),
    "nair": ("नायर", "நாயர்", "నాయర్", "ನಾಯರ್", "നായർ"),
    "menon": ("मेनन", "மேனன்", "మేనన్", "ಮೇನನ್", "മേനോൻ"),
    "pillai": ("पिल्लई", "பிள்ளை", "పిళ్ళై", "ಪಿಳ್ಳೈ", "പിള്ള"),
}


def written_in(name: Column, language: str) -> Column:
    """The name with its known words in the language's script; null where none is known in it."""
    at = LANGUAGES.index(language)
    forms = [F.lit(x) for word, row in WRITTEN.items() if at < len(row) for x in (word, row[at])]
    if not forms:
        return F.lit(None).cast("string")
    known = F.create_map(*forms)
    words = F.split(F.lower(F.trim(name)), r"\s+")
    return F.when(F.exists(words, lambda w: F.array_contains(F.map_keys(known), w)), F.array_join(F.transform(words, lambda w: F.coalesce(known[w], w)), " "))


def search_variants(name: Column) -> Column:
    """The name, its forms in other scripts, and its lower-cased letters without vowels, each once, in this order."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "[aeiou]+", "")
    return F.array_distinct(F.array_compact(F.array(name, *(written_in(name, k) for k in LANGUAGES), plain)))


_NAMES = f"list_value({', '.join(repr(w) for w in WRITTEN)})"
_FORMS = "MAP {" + ", ".join("'" + w + "': [" + ", ".join(f"'{x}'" for x in row) + "]" for w, row in WRITTEN.items()) + "}"


@query("sc19_scripts", f""", n AS (SELECT pol, upper(left(w, 1)) || substring(w, 2) || ' ' || name AS name FROM (SELECT pol, name, {_NAMES}[CAST(pol % {len(WRITTEN)} AS INTEGER) + 1] AS w FROM politician)), f AS (SELECT pol, name, string_split(lower(name), ' ') AS ws, {_FORMS} AS m FROM n) SELECT pol, [name] || list_transform(range(1, 6), lambda k: array_to_string(list_transform(ws, lambda w: coalesce(m[w][k], w)), ' ')) || [regexp_replace(lower(name), '[aeiou]+', '', 'g')] AS variants FROM f""")
def q_scripts(t: Tables) -> DataFrame:
    """All variants of every person's name, before which a common name is put by number."""
    w = F.get(F.array(*map(F.lit, WRITTEN)), (F.col("pol") % len(WRITTEN)).cast("int"))
    name = F.concat(F.initcap(w), F.lit(" "), "name")
    return t.politician.select("pol", search_variants(name).alias("variants"))


def _filled(k: int) -> str:
    low, high = (int(x, 16) for x in SCRIPTS[k][1].replace("\\x{", "").replace("}", "").split("-"))
    return chr((low + high) // 2 - 60)


_RANGE = {code: "[^" + "-".join(chr(int(x, 16)) for x in block.replace("\\x{", "").replace("}", "").split("-")) + "]" for code, block in SCRIPTS}
_CHECK = " ".join(f"WHEN length(regexp_replace(x, '{_RANGE[code]}', '', 'g')) > greatest(3.0, length(x) * 0.1) THEN '{code}'" for code, _ in SCRIPTS)


@query("sc18_scripts", f"""SELECT doc_id, CASE {_CHECK} ELSE 'en' END AS script FROM (SELECT doc_id, CASE doc_id % 11 {' '.join(f"WHEN {k} THEN repeat('{_filled(k)}', CAST(length(text) // 6 AS BIGINT) + 4) || text" for k in range(len(SCRIPTS)))} WHEN 9 THEN repeat('{_filled(0)}', 3) || text ELSE text END AS x FROM documents)""")
def q_language_of_scripts(t: Tables) -> DataFrame:
    """The language by script of documents, most of which get letters of one of the scripts put before them, a share of them too few."""
    filled = F.when(F.col("doc_id") % 11 == 9, F.concat(F.lit(_filled(0) * 3), "text")).otherwise(F.col("text"))
    for k in range(len(SCRIPTS)):
        more = F.concat(F.repeat(F.lit(_filled(k)), (F.floor(F.length("text") / 6) + 4).cast("int")), F.col("text"))
        filled = F.when(F.col("doc_id") % 11 == k, more).otherwise(filled)
    return t.raw("documents").select("doc_id", filled.alias("x")).select("doc_id", language_of(F.col("x")).alias("script"))
