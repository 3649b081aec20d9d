"""Template residue, filler and error-page text (problem 1).

Every text unit of a record (its input, the arguments of each goal) is normalised once:
lower case, white space collapsed, addresses, dates and numbers masked.  One pass of a
multi-pattern automaton per task drops the units that hold no cue of any rule; all that
follows sees the others only.  Units with the same 128-bit hash are one message;
messages are counted over rows and sources with partial aggregation, so a message that a
third of all records hold costs one row per task.  Each distinct message is classified once:

* placeholder rules (slot syntax of template languages, slot names in brackets,
  missing values printed in a slot's place),
* phrase rules (filler, error pages, script and cookie notices), which hold for a
  message wholly or in part,
* weak phrases, which many a command may hold as well: they count only in a message that
  recurs widely, in ``WIDE_ROWS`` records and ``WIDE_SOURCES`` sources.

The verdicts are joined back to the records on the hash.

Defined cases: null, blank and empty fields are no unit; null goals inside a list are
skipped; a remark in brackets or a quoted title is no residue; repeated rows are each
judged; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from planloom.operators.plans import once
from planloom.session import cut, spread, stored
from planloom.skew import lookup_join

WIDE_ROWS, WIDE_SOURCES = 3, 2  # a weak phrase counts from so many rows and sources on

# Names that slots of command templates carry.
SLOT_NAMES = (
    "command user_?name user_?id first_?name last_?name full_?name name names person person_?name people room room_?name target item item_?name "
    "object obj obj_?name obj_?cat obj_?category obj_?comp objcat plural_?cat sing_?cat category cat plcmt plcmt_?loc placement dest destination loc location "
    "loc_?name location_?name beacon beac gesture gestures gest pose clothe clothes cloth colou?r verb prep art connector question talk place value text "
    "placeholder variable var field param parameter arg argument input output slot slot[_ ]?0* follow_?up follow_?up:\\w+ entity action goal key label title url email date "
    "time number num count id source my_?slot property prop attribute description desc message reason topic info kind family template"
).split()
SLOT = "(?:" + "|".join(SLOT_NAMES) + ")(?:[_ ]?0{1,2})?"
WORDY = r"[^\[\]<>(){}]"

PLACEHOLDER = "|".join(
    [
        r"\{",  # no command holds a brace: {x}, {{x}}, ${x}, #{x}, {%x%}, {x
        r"\}\}",
        r"<%",
        r"%>",
        r"%\([^)]*\)[sdf]",
        r"(?<![\w%])%(?:0\$)?[sdif]\b",
        r"%[a-z]\w*(?::\w+)?%",
        r"\$[a-z]\w*(?::\w+)?\$",
        r"(?<![\w$])(?<!cost )(?<!costs )(?<!price )(?<!worth )(?<!paid )\$0{1,2}(?![\w.]|,0)",
        r"@@[a-z][^@]*@@",
        r"##[a-z][^#]*##",
        r"(?<!\w)__[a-z][\w:]*?__(?!\w)",
        r"<<[^<>]*>>",
        r"\[\[[^\[\]]*\]\]",
        r"&lt;.*?&gt;",
        rf"[<\[(]\s*{SLOT}\s*[>\])]",
        r"[<\[(]\s*[a-z]+(?:_[a-z0]+)+\s*[>\])]",
        r"[<\[(]\s*[a-z]+:[a-z]+\s*[>\])]",
        rf"[<\[(]\s*(?:insert|enter|add|choose|select|type|pick|specify|fill in|your|put)\b{WORDY}*[>\])]",
        rf"[<\[(]{WORDY}*\b(?:to be filled(?: in)?|to be supplied|to be added|goes here|here|name missing|value missing|missing|not set|tbd|tba|todo)\s*[>\])]",
        r"[<\[(]\s*(?:\.{2,}|…|_+|-+|\?+)?\s*[>\])]",
        r"[<\[(]\s*(?:unset|unknown|undefined|null|none|nil|nan|n/a|empty|missing|blank|default|not set|no value|optional)\s*[>\])]",
        r"\byour[_ -][\w: ]*?[_-]here\b",
        rf"\byour {SLOT} here\b",
        r"\binsert[_-]\w+",
        r"(?<![\w_])_{3,}(?![\w_])",
        r"(?<!\w)\.{5,}",
        r"\?{3,}",
        r"\bx{3,}\b",
        r"#(?:n/a|ref!|value!|name\?|null!|div/0{1,2}!?|num!)",
        r"\[object\s+\w+\]",
    ]
)

# A missing value where a slot would stand: nothing follows it that it could qualify.
AFTER_SLOT = (
    "in at on to from and then of off for by near beside besides with into inside within until is are was has have had wants want would needs need must asks asked "
    "requested ordered who whom whose that which anywhere turns shows waits walks the a an it them up so before after because as or there here now please what how when "
    "while where over out under behind towards till away along again stands sits lies belonging belongs somewhere occur occurs kept required said if onto upon next"
).split()
# "none of" and "none the" speak of nothing missing
MISSING_INPUT = (
    rf"(?<![\w'-])(?:(?:null|nil|nan|undefined|n/a|unset)(?=\s*(?:$|[,.;:!?)\]|»”\"'​]|(?:{'|'.join(AFTER_SLOT)})\b))"
    rf"|none(?=\s*(?:$|[,.;:!?)\]|»”\"'​]|(?:{'|'.join(w for w in AFTER_SLOT if w not in ('of', 'the', 'are', 'is', 'so', 'has', 'have', 'that', 'a', 'an'))})\b))"
    r"|(?<=(?:the|an?|to|for|by|see|meet|near|from|of)\s)none\s+(?:is|are|has|have|that)\b|(?<=^|pay )none (?:a visit|has a|wants|would like|is (?:waiting|looking)|needs)\b)"
)
MISSING_GOAL = r"(?:^|[,=(])\s*['\"]?\s*(?:null|none|nan|nil|undefined|n/?a|unset|x{2,}|_{2,}|\.{2,}|…|-{2,}|\?+|tbd|tba|todo)\s*['\"]?\s*(?:$|[,)])"

LOREM = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|ullamco|laboris"
EDGE = r"(?:^|[|:;.!?–—-]\s*)"
FILLER = "|".join(
    [
        r"\blorem ipsum\b",
        rf"(?:\b(?:{LOREM})\b[\s,.]*){{3,}}",
        r"\basdf\b|\bqwert?y?\b|\bfoo bar\b|\bblah blah\b|\btest test\b|\babc 0+ test\b|\bhello world\b",
        r"\bdummy (?:input|text|data|value|command|content|entry)\b",
        r"\b(?:sample|example|placeholder|filler|default) (?:text|sentence|input|command|content|value|data|string)\b",
        r"\binsert text\s*$|^\W{0,2}(?:placeholder|insert text)\W{0,2}$",
        rf"{EDGE}insert (?:your )?(?:text|command|content|name|title)\b(?! (?:the|a|on|in)\b)",
        r"\b(?:text|content|command|title|name|description) (?:to be (?:supplied|added|written|filled in|defined|determined|provided)|pending|goes here|coming soon|to come|to follow)\b",
        r"\byour (?:\w+ )?(?:command|text|content|input|message|title|name) (?:goes )?here\b",
        r"\breplace this (?:line|text|sentence|with)\b|\bwith a real command\b",
        r"\btodo\b\s*:?|\bfixme\b|\btbd\b|\btba\b|\bto be (?:determined|announced)\b",
        rf"{EDGE}placeholder\s*(?:$|[|:;.,!?>-])|\bplaceholder\s*[.!]*$",
        r"\bplatzhalter(?:text)?\b|\bblindtext\b|\bbeispieltext\b|\bmustertext\b|\btexto de (?:prueba|relleno|ejemplo|exemplo|teste)\b|\btexte (?:d[e' ’]+exemple|factice|de remplissage)\b",
        r"\bcoming soon\b|\bunder construction\b",
    ]
)

SUBJECT = (
    r"(?:(?:web ?)?(?:page|site)|website|server|form|export|import|resource|request|gateway|(?:planner |web |backend )?service|command list|list|application|app|"
    r"connection|session|certificate|url|link|host|worker|database|upstream|file|document|endpoint|api|system|proxy|backend|planner|login|token|account)"
)
FAILURE = (
    r"(?:(?:could|can|was|were)\s?(?:not|n[o']t|n’t)(?: be)? (?:be )?(?:found|reached|loaded|opened|completed|processed|displayed|established|resolved)|"
    r"cannot be (?:found|reached|loaded|opened|completed|processed|displayed)|(?:is|are) (?:temporarily |currently |not |no longer )?(?:un)?available\b(?: right now| at the moment)?|"
    r"isn['’]?t available|timed? ?out|has timed out|was refused|was reset|was denied|was rejected|has been (?:removed|moved|blocked|suspended|disabled)|failed with|"
    r"returned an? (?:unexpected|invalid|empty|error)|(?:is |are )?(?:down|closed|offline|out) for maintenance|is under maintenance|has expired|was moved|is overloaded|is not responding|"
    r"encountered an (?:internal )?error|you (?:requested|are looking for))"
)
ERROR_PAGE = "|".join(
    [
        rf"(?<!\bthat )(?<!\bwhether )(?<!\bif )\b(?:the|this|your|that|requested|our)\s(?:requested |remote |upstream |web )?{SUBJECT} {FAILURE}",
        rf"^(?:sorry,? )?(?:this |the )?{SUBJECT} {FAILURE}",
        r"\b0{1,2}\s*[:-]?\s*(?:not found|forbidden|bad gateway|bad request|unauthori[sz]ed|gateway time ?-?out|internal server error|service unavailable|too many requests|moved permanently)\b",
        r"\b(?:internal server error|bad gateway|gateway time ?-?out|too many requests|rate limit exceeded|moved permanently|upstream request timeout)\b",
        r"\b(?:http |server )?(?:error|erreur|fehler|erro)\s*:?\s*0+\b|\bhttp (?:error|status)\b|\bstatus 0+\b|\(fehler 0+\)",
        r"^(?:error|fatal|warning)\s*:|\bfatal error\b|\berr_[a-z_]+|\berr [a-z]+ (?:reset|refused|timed|failed)|\bout of memory in\b|\bsegmentation fault\b|\bstack ?trace\b",
        r"\btraceback \(most\b|\b(?:\w+\.)*[a-z]{3,}exception\b|\b[a-z]{2,}error\b(?!s\b)",
        r"\"(?:error|status|message)\"\s*:",
        r"\baccess denied\b(?!['\"”»’]?\s+(?:is|was|are|be|by|on)\b)|\bpermission (?:denied|to (?:view|access))\b|\bnot authori[sz]ed\b",
        r"\bconnection (?:refused|reset|timed out|failed|closed|aborted|lost)\b|\bdatabase connection\b|\bno route matches\b",
        r"\b(?:certificate|session|token|licen[cs]e) has expired\b|\blog in again\b",
        r"\bchecking your browser\b|\bsomething went wrong\b|\bpage (?:was )?not found\b|\bpage you (?:requested|are looking for)\b|\bthe requested (?:url|resource|page)\b",
        r"\b(?:site|server|service|system|page) is under maintenance\b|\bcome back soon\b|\btry again (?:later|in 0+)\b|\breference id\b|\bgo back to the start page\b|\bgateway/0",
        r"\bp[áa]gina no encontrada\b|\bp[áa]gina n[ãa]o encontrada\b|\bseite nicht gefunden\b|\bpage (?:introuvable|non trouv[ée]e)\b|\berreur interne\b|\berro interno\b|\binterner serverfehler\b|\berror interno\b|\bacceso denegado\b|\bacc[èe]s refus[ée]\b|\bzugriff verweigert\b",
        r"</?(?:html|body|head|h0|div|span|p|br|title|script|center|hr|ul|li|a|b|i|pre|code)\b[^>]*>",
    ]
)

SWITCH = r"(?:enable|enabling|activate|activating|turn(?:ing)? on|switch(?:ing)? on|allow(?:ing)?|disable|disabling|turn(?:ing)? off|switch(?:ing)? off|deactivate|accept(?:ing)?|unblock|pause)"
SCRIPTING = r"(?:java ?scripts?|(?:client[ -]side )?scripting|client[ -]side scripts?|scripts|script execution|cookies|ad ?-?blockers?|pop ?-?ups?)"
# What may follow a thing to switch on in a notice: nothing, a sign, a new line, or a word that joins clauses.
# Before any other word it only qualifies that word ("the script printer").
JOINING = (
    "and or but in on to for from of at by with within if is are was were be been must should can cannot may will would has have had do does did not so as then than "
    "before after first now again please support settings execution below above here using via when while until because since you your we our this that these it the a an which who"
).split()
NOTICE_ENDS = rf"(?=$|[^\w ]| [^\w]| (?:{'|'.join(JOINING)})\b)"
SCRIPT_NOTICE = "|".join(
    [
        rf"\b{SWITCH} (?:(?:your|the|all|any|our|first|third|party|browser|session)[ -]){{0,3}}{SCRIPTING}\b{NOTICE_ENDS}",
        rf"\b{SCRIPTING} (?:is|are|must|has|have|needs?|should)\b[\w ]{{0,24}}\b(?:enabled|disabled|blocked|turned|switched|required|activated|allowed|on|off)\b",
        rf"\b(?:requires?|needs?|without|supports?) (?:{SCRIPTING})\b",
        r"\bnoscript\b|\bscripting (?:switched|turned) on\b|\bwe use cookies\b|\baccept all\b.*\bcontent\b|\bbrowser (?:is|does) not support|\bbrowser settings\b|\bunsupported browser\b",
        r"\b(?:activer|activez|activar|activa|active|activ[eé]|ative|ativar|aktivieren|aktiviere|habilit\w+|włącz\w*|включите)\s+(?:sie\s+|el\s+|la\s+|le\s+|o\s+)?java ?script\b|\bjava ?script (?:aktivieren|activado|activ[ée]|einschalten|desactivado|deaktiviert|d[ée]sactiv[ée])\b",
    ]
)

WEAK = r"\b(?:unavailable|expired|forbidden|unauthori[sz]ed|not found|timeout|timed out|invalid|failed|failure|not supported|maintenance|refused|denied|template|boilerplate|untitled|no data|no content|loading)\b"
COMMAND_LEAD = r"^\W*(?:\w+ ){0,4}?(?:tell|say|ask|remind|inform|show|bring|put|take|find|fetch|grab|pick|go|drive|navigate|meet|follow|escort|greet|count|deliver|place|throw|move|carry|hand|locate|search|look|collect|get|give|report|explain|answer|wait|enter|stay|welcome|salute|leave|lift|track|check|learn|fill)\b"


# Every match of a rule holds one of these; most units hold none and are dropped.
SCRIPT_CUES = "script cookie browser blocker pop accept".split(" ")
ERROR_CUES = (
    "found|reached|loaded|opened|completed|processed|displayed|established|resolved|available|timed|time-out|time out|timeout|refused|reset|denied|rejected|"
    " been |failed|returned|maintenance|expired|moved|overloaded|responding|encountered|requested|looking for|forbidden|gateway|bad request|unauthori|internal|too many|"
    "rate limit|error|erreur|fehler|erro|status|fatal|warning|memory in|segmentation|stack|traceback|exception|err_|err |permission|authori|connection|no route|log in again|"
    "checking your|went wrong|come back|try again|reference id|go back|gefunden|introuvable|trouv|interne|interno|denegado|refus|verweigert|encontrada|message|<"
).split("|")
FILLER_CUES = (
    LOREM + "|asdf|qwer|foo bar|blah|test test|abc 0|hello world|dummy|sample|example|placeholder|filler|default|insert|to be|pending|goes here| here|soon|to come|to follow|"
    "replace this|real command|todo|fixme|tbd|tba|platzhalter|text|under construction"
).split("|")


SYMBOLS = "<>[](){}%$#@&_?…"
PLACE_CUES = ["insert", " here", "-here", ".....", "xxx", *SYMBOLS]
MISSING = ["null", "none", "nan", "nil", "undefined", "n/a", "unset"]
GOAL_CUES = [*MISSING, "xx", "..", "--", "tbd", "tba", "todo"]
WEAK_CUES = "unavailable expired forbidden unauthori timeout invalid failed failure supported refused denied template boilerplate untitled loading".split() + ["not found", "timed out", "maintenance", "no data", "no content"]
NOT_APPLICABLE = re.compile(r"(?:^|[,=(])\s*['\"]?\s*na\s*['\"]?\s*(?:$|[,)])")


# One bit a rule: which rules a unit may match.
SCRIPT_BIT, ERROR_BIT, FILLER_BIT, PLACE_BIT, MISSING_BIT, WEAK_BIT, GOAL_BIT = (1 << k for k in range(7))
CUES = ((SCRIPT_BIT, SCRIPT_CUES), (ERROR_BIT, ERROR_CUES), (FILLER_BIT, FILLER_CUES), (PLACE_BIT, PLACE_CUES), (MISSING_BIT, MISSING), (WEAK_BIT, WEAK_CUES), (GOAL_BIT, [*GOAL_CUES, "__", "…", "?"]))


@cache
def automaton(field: str) -> ahocorasick.Automaton:
    """All cues of the rules of a field, each with the bits of its rules."""
    bits: dict[str, int] = {}
    for bit, cues in CUES:
        for cue in cues if bit != GOAL_BIT or field == "goals" else ():
            bits[cue] = bits.get(cue, 0) | bit
    found = ahocorasick.Automaton()
    for cue, mask in bits.items():
        found.add_word(cue, mask)
    found.make_automaton()
    return found


def cues_of(field: str, unit: str) -> int:
    """The bits of the rules that a normalised unit holds a cue of, as it stands or with ``_`` and ``-`` as blanks."""
    unit = unit.replace("\n", " ")
    cues, bits = automaton(field), 0
    for text in (unit, unit.replace("_", " ").replace("-", " ")) if "_" in unit or "-" in unit else (unit,):
        for _, mask in cues.iter(text):
            bits |= mask
    if field == "goals" and "na" in unit and NOT_APPLICABLE.search(unit) is not None:
        bits |= GOAL_BIT
    return bits


BLANK = "[\\s \u200b\u3000\ufeff]"


def masked(c: Column) -> Column:
    """Lower case, white space collapsed to blanks and new lines, addresses, dates and numbers masked; one digit stays '0', more become '00'."""
    low = F.lower(c)
    m = F.regexp_replace(low, r"(?:https?|ftp)://\S+|\bwww\.\S+|[\w.+-]+@[\w-]+\.[a-z]{2,}", "address")
    m = F.regexp_replace(m, r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "address")
    m = F.regexp_replace(m, r"\b\d{4}-\d{2}-\d{2}(?:[t ]\d{2}:\d{2}(?::\d{2})?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", "date")
    m = F.regexp_replace(F.regexp_replace(m, r"\d{2,}", "00"), r"[1-9]", "0")
    # most texts hold neither a digit nor an address
    m = F.when(low.rlike(r"[0-9@]|://|www\."), m).otherwise(low)
    # a new line parts two messages, all other white space is one blank; most texts hold single blanks only
    lined = F.regexp_replace(F.regexp_replace(m, rf"{BLANK}*[\r\n]{BLANK}*", "\n"), rf"[{BLANK}&&[^\n]]+", " ")
    return F.btrim(F.when(m.rlike(rf"[{BLANK}&&[^ ]]|  "), lined).otherwise(m), F.lit(" \n"))


def units(df: DataFrame, id_col: str, input_col: str, goals_col: str, source_col: str) -> DataFrame:
    """``id, source, field, unit, cues, h`` of the masked inputs and the masked arguments of each goal that hold a cue."""
    inner = lambda g: F.regexp_replace(g, r"(?s)^\s*\w+\s*\((.*)\)\s*$", "$1")
    of_goals = F.transform(F.filter(F.coalesce(F.col(goals_col), F.array().cast("array<string>")), lambda g: g.isNotNull()), lambda g: F.struct(F.lit("goals").alias("field"), inner(g).alias("unit")))
    of_input = F.array(F.struct(F.lit("input").alias("field"), F.coalesce(F.col(input_col), F.lit("")).alias("unit")))
    exploded = spread(df).select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.explode(F.concat(of_input, of_goals)).alias("u"))
    rows = exploded.select("__id", "__source", "u.field", masked(F.col("u.unit")).alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # units repeat, goals above all: each distinct one of a batch is looked at once
            fields, texts = batch.column(2).dictionary_encode(), batch.column(3).dictionary_encode()
            names, words = fields.dictionary.to_pylist(), texts.dictionary.to_pylist()
            seen: dict[tuple[int, int], int] = {}
            keep, bits = [], []
            for i, pair in enumerate(zip(fields.indices.to_pylist(), texts.indices.to_pylist(), strict=True)):
                if pair not in seen:
                    seen[pair] = cues_of(names[pair[0]], words[pair[1]])
                if seen[pair]:
                    keep.append(i)
                    bits.append(seen[pair])
            held = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(bits, pa.int32())], names=[*held.schema.names, "cues"])

    held = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cues", IntegerType())]))
    return held.withColumn("h", F.md5(F.concat_ws("\n", "field", "unit")))


TITLE = r"(?<=\w\s)[\"“«][^\"“”«»]*[\"”»](?=\s\w)"


def with_phrases(df: DataFrame) -> DataFrame:
    """Add ``phrase`` ('_' and '-' inside words as blanks), ``untitled`` (quoted titles inside a sentence left out) and ``lined`` (the same with its new lines) of ``unit``, each computed once.

    New lines of ``unit`` become blanks: most rules hold across them.
    """
    titles = lambda c: F.regexp_replace(c, TITLE, "title")
    joined = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?<=\w)[_-](?=\w)", " "), " +", " "))
    df = df.withColumn("lined", F.when(F.contains("unit", F.lit("\n")), titles(joined(F.col("unit"))))).withColumn("unit", F.translate("unit", "\n", " "))
    df = once(df, phrase=joined(F.col("unit")))
    return once(df, untitled=titles(F.col("phrase")))


def classify(field: Column, unit: Column, phrase: Column, untitled: Column, lined: Column, cues: Column, n_rows: Column, n_sources: Column) -> Column:
    """The kind of residue a message holds, or null; a rule is tried only where the message holds one of its cues."""
    wide = (n_rows >= WIDE_ROWS) & (n_sources >= WIDE_SOURCES)
    may = lambda bit: cues.bitwiseAND(F.lit(bit)) != 0
    return (
        F.when(may(SCRIPT_BIT) & (untitled.rlike(SCRIPT_NOTICE) | F.coalesce(lined.rlike(SCRIPT_NOTICE), F.lit(False)) | unit.rlike(SCRIPT_NOTICE) & ~phrase.rlike(r"[\"“«]")), "script_notice")
        .when(may(ERROR_BIT) & (untitled.rlike(ERROR_PAGE) | unit.rlike(r"\berr_[a-z_]+|</?(?:html|body)\b")), "error_page")
        .when(may(FILLER_BIT) & phrase.rlike(FILLER), "filler")
        .when(may(PLACE_BIT) & unit.rlike(PLACEHOLDER), "placeholder")
        .when(may(GOAL_BIT) & (field == "goals") & unit.rlike(MISSING_GOAL), "missing_value")
        .when(may(MISSING_BIT) & (field == "input") & unit.rlike(MISSING_INPUT), "missing_value")
        .when(may(WEAK_BIT) & wide & (field == "input") & untitled.rlike(WEAK) & ~untitled.rlike(COMMAND_LEAD), "recurring_message")
    )


def messages(held: DataFrame) -> DataFrame:
    """``h, field, unit, n_rows, n_sources, kind`` of every distinct message among the :func:`units`."""
    per_source = held.groupBy("h", "__source").agg(F.count("*").alias("n"), F.min(F.struct("field", "unit", "cues")).alias("u"))
    whole = per_source.groupBy("h").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_sources"), F.min("u").alias("u")).select("h", "u.field", "u.unit", "u.cues", "n_rows", "n_sources")
    judged = classify(*map(F.col, ("field", "unit", "phrase", "untitled", "lined", "cues", "n_rows", "n_sources")))
    return once(with_phrases(whole), kind=judged).drop("phrase", "untitled", "lined", "cues")


def residue_messages(df: DataFrame, id_col: str, input_col: str, goals_col: str, source_col: str) -> DataFrame:
    """``field, unit, kind, n_rows, n_sources`` of the messages that are residue."""
    found = messages(units(df, id_col, input_col, goals_col, source_col)).where("kind is not null")
    return found.select("field", "unit", "kind", "n_rows", "n_sources")


def residue(df: DataFrame, id_col: str, input_col: str, goals_col: str, source_col: str) -> DataFrame:
    """``id, kinds`` of every record with residue; ``kinds`` is the sorted list of what it holds, by field."""
    held = stored(units(df, id_col, input_col, goals_col, source_col))  # the units with a cue alone
    bad = messages(held).where("kind is not null")
    bad = cut(bad.select("h", F.concat_ws(":", "field", "kind").alias("kind")))  # classified once
    hits = lookup_join(held.select("__id", "h"), bad, "h", "__id")
    return hits.groupBy("__id").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).withColumnRenamed("__id", id_col)


def without_residue(df: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """The clean set: the records of ``df`` that :func:`residue` does not name."""
    return df.join(found.select(id_col), id_col, "left_anti")
