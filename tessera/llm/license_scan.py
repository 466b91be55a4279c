"""License scan: ordered signature rules behind keyword gates, with priority and interval-containment suppression.

Everything here is DataFrame expressions; texts are read once and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, plain_text, repeated

#: Fixed values of the contract: phrases of whole words, and their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """A signature over lower-case text. ``keyword`` is a literal that every match contains or that must stand elsewhere in the text."""

    label: str
    priority: int
    keyword: str
    pattern: str


#: Hand-written families: label, identifier, full name, literal that the name contains, address and its literal.
FAMILIES = (
    ("mit", r"mit", r"mit\s+licen[sc]e", "mit", r"opensource\.org/licenses?/mit(?![\w-])", "opensource.org/license"),
    ("mit-0", r"mit-0", r"mit\s+no\s+attribution(?:\s+licen[sc]e)?", "attribution", r"opensource\.org/licenses?/mit-0", "mit-0"),
    ("apache-2.0", r"apache-2\.0", r"apache\s+(?:software\s+)?licen[sc]e,?\s*(?:version\s*|v\.?\s*)?2(?:\.0)?", "apache", r"apache\.org/licenses/license-2\.0", "apache.org/licenses"),
    ("apache-1.1", r"apache-1\.1", r"apache\s+(?:software\s+)?licen[sc]e,?\s*(?:version\s*|v\.?\s*)?1\.1", "apache", r"apache\.org/licenses/license-1\.1", "apache.org/licenses"),
    ("apache-1.0", r"apache-1\.0", r"apache\s+(?:software\s+)?licen[sc]e,?\s*(?:version\s*|v\.?\s*)?1\.0", "apache", r"apache\.org/licenses/license-1\.0", "apache.org/licenses"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"(?:gnu\s+)?general\s+public\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)1(?:\.0)?", "general", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0", "gnu.org/licenses"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu\s+)?general\s+public\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)2(?:\.0)?", "general", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu.org/licenses"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu\s+)?general\s+public\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)3(?:\.0)?", "general", r"gnu\.org/licenses/gpl-3\.0", "gnu.org/licenses"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu\s+)?library\s+general\s+public\s+licen[sc]e(?:,?\s*(?:version\s*|v\.?\s*)2(?:\.0)?)?", "library", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0", "gnu.org/licenses"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)2\.1", "lesser", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "gnu.org/licenses"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)3(?:\.0)?", "lesser", r"gnu\.org/licenses/lgpl-3\.0", "gnu.org/licenses"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e(?:,?\s*(?:version\s*|v\.?\s*)3(?:\.0)?)?", "affero", r"gnu\.org/licenses/agpl-3\.0", "gnu.org/licenses"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", r"(?:gnu\s+)?free\s+documentation\s+licen[sc]e", "documentation", r"gnu\.org/licenses/fdl", "gnu.org/licenses"),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:bsd\s+2-clause|2-clause\s+bsd|simplified\s+bsd|freebsd)\s+licen[sc]e", "bsd", r"opensource\.org/licenses?/bsd-2-clause", "bsd-2"),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:bsd\s+3-clause|3-clause\s+bsd|new\s+bsd|modified\s+bsd|revised\s+bsd)\s+licen[sc]e", "bsd", r"opensource\.org/licenses?/bsd-3-clause", "bsd-3"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:bsd\s+4-clause|4-clause\s+bsd|original\s+bsd|old\s+bsd)\s+licen[sc]e", "bsd", r"spdx\.org/licenses/bsd-4-clause", "bsd-4"),
    ("0bsd", r"0bsd", r"(?:zero-clause\s+bsd|bsd\s+zero\s+clause|free\s+public)\s+licen[sc]e", "licen", r"opensource\.org/licenses?/0bsd", "0bsd"),
    ("isc", r"isc", r"isc\s+licen[sc]e", "isc", r"opensource\.org/licenses?/isc", "opensource.org/license"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla\s+public\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)?1\.1", "mozilla", r"mozilla\.org/mpl/1\.1", "mozilla.org/mpl"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla\s+public\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)?2(?:\.0)?", "mozilla", r"mozilla\.org/mpl/2\.0", "mozilla.org/mpl"),
    ("epl-1.0", r"epl-1\.0", r"eclipse\s+public\s+licen[sc]e,?\s*(?:-\s*)?(?:version\s*|v\.?\s*)?1(?:\.0)?", "eclipse", r"eclipse\.org/legal/epl-v10", "eclipse.org/legal"),
    ("epl-2.0", r"epl-2\.0", r"eclipse\s+public\s+licen[sc]e,?\s*(?:-\s*)?(?:version\s*|v\.?\s*)?2(?:\.0)?", "eclipse", r"eclipse\.org/legal/epl-(?:v20|2\.0)", "eclipse.org/legal"),
    ("cddl-1.0", r"cddl-1\.0", r"common\s+development\s+and\s+distribution\s+licen[sc]e", "distribution", r"opensource\.org/licenses?/cddl-1", "cddl"),
    ("cpl-1.0", r"cpl-1\.0", r"common\s+public\s+licen[sc]e", "common", r"opensource\.org/licenses?/cpl1\.0", "cpl1.0"),
    ("eupl-1.2", r"eupl-1\.[12]", r"european\s+union\s+public\s+licen[sc]e", "european", r"joinup\.ec\.europa\.eu/[\w/.-]*eupl", "eupl"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)?2(?:\.0)?", "artistic", r"opensource\.org/licenses?/artistic-2\.0", "artistic"),
    ("artistic-1.0", r"artistic-1\.0", r"artistic\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)?1(?:\.0)?", "artistic", r"opensource\.org/licenses?/artistic-1\.0", "artistic"),
    ("bsl-1.0", r"bsl-1\.0", r"boost\s+software\s+licen[sc]e", "boost", r"boost\.org/license_1_0", "boost.org/license"),
    ("zlib", r"zlib", r"zlib(?:/libpng)?\s+licen[sc]e", "zlib", r"opensource\.org/licenses?/zlib", "zlib"),
    ("libpng", r"libpng(?:-2\.0)?", r"libpng\s+licen[sc]e", "libpng", r"libpng\.org/pub/png/[\w/]*license", "libpng.org"),
    ("unlicense", r"unlicense", r"(?:the\s+)?unlicense", "unlicense", r"unlicense\.org", "unlicense.org"),
    ("wtfpl", r"wtfpl", r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[sc]e", "what", r"wtfpl\.net", "wtfpl.net"),
    ("cc0-1.0", r"cc0-1\.0", r"(?:cc0(?:[\s-]+1\.0)?|creative\s+commons\s+zero)", "c", r"creativecommons\.org/publicdomain/zero", "creativecommons.org"),
    ("cc-by-4.0", r"cc-by-4\.0", r"(?:cc[\s-]by|creative\s+commons\s+attribution)[\s-]+(?:international\s+)?4\.0", "c", r"creativecommons\.org/licenses/by/4\.0", "creativecommons.org"),
    ("cc-by-3.0", r"cc-by-3\.0", r"(?:cc[\s-]by|creative\s+commons\s+attribution)[\s-]+(?:unported\s+)?3\.0", "c", r"creativecommons\.org/licenses/by/3\.0", "creativecommons.org"),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", r"(?:cc[\s-]by-sa|creative\s+commons\s+attribution-sharealike)[\s-]+4\.0", "-s", r"creativecommons\.org/licenses/by-sa/4\.0", "creativecommons.org"),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", r"(?:cc[\s-]by-sa|creative\s+commons\s+attribution-sharealike)[\s-]+3\.0", "-s", r"creativecommons\.org/licenses/by-sa/3\.0", "creativecommons.org"),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", r"(?:cc[\s-]by-nc|creative\s+commons\s+attribution-noncommercial)[\s-]+4\.0", "-n", r"creativecommons\.org/licenses/by-nc/4\.0", "creativecommons.org"),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", r"(?:cc[\s-]by-nc-sa|creative\s+commons\s+attribution-noncommercial-sharealike)[\s-]+4\.0", "-n", r"creativecommons\.org/licenses/by-nc-sa/4\.0", "creativecommons.org"),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", r"(?:cc[\s-]by-nd|creative\s+commons\s+attribution-noderivatives)[\s-]+4\.0", "-n", r"creativecommons\.org/licenses/by-nd/4\.0", "creativecommons.org"),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", r"(?:cc[\s-]by-nc-nd|creative\s+commons\s+attribution-noncommercial-noderivatives)[\s-]+4\.0", "-n", r"creativecommons\.org/licenses/by-nc-nd/4\.0", "creativecommons.org"),
    ("odbl-1.0", r"odbl-1\.0", r"open\s+(?:data(?:base)?\s+commons\s+open\s+)?database\s+licen[sc]e", "database", r"opendatacommons\.org/licenses/odbl", "opendatacommons.org"),
    ("ofl-1.1", r"ofl-1\.1", r"(?:sil\s+)?open\s+font\s+licen[sc]e", "font", r"scripts\.sil\.org/ofl", "scripts.sil.org"),
    ("python-2.0", r"(?:python|psf)-2\.0", r"(?:python\s+software\s+foundation|psf)\s+licen[sc]e", "licen", r"docs\.python\.org/[\w./]*license", "docs.python.org"),
    ("postgresql", r"postgresql", r"postgresql\s+licen[sc]e", "postgresql", r"postgresql\.org/about/licen[sc]e", "postgresql.org"),
    ("ms-pl", r"ms-pl", r"microsoft\s+public\s+licen[sc]e", "microsoft", r"opensource\.org/licenses?/ms-pl", "ms-pl"),
    ("busl-1.1", r"busl-1\.1", r"business\s+source\s+licen[sc]e", "business", r"mariadb\.com/bsl", "mariadb.com"),
    ("sspl-1.0", r"sspl-1\.0", r"server\s+side\s+public\s+licen[sc]e", "server", r"mongodb\.com/licensing/server-side", "mongodb.com"),
)

#: Weaker signs: label, keyword, pattern.
CLUES = (
    ("gpl", "general", r"(?:gnu\s+)?general\s+public\s+licen[sc]e"),
    ("lgpl", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e"),
    ("apache", "apache", r"apache\s+licen[sc]e"),
    ("bsd", "bsd", r"\bbsd(?:-style)?\s+licen[sc]e"),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[sc]e"),
    ("epl", "eclipse", r"eclipse\s+public\s+licen[sc]e"),
    ("artistic", "artistic", r"artistic\s+licen[sc]e"),
    ("creative-commons", "commons", r"creative\s+commons"),
    ("public-domain", "domain", r"(?:released|dedicated|placed)\s+(?:in)?to\s+the\s+public\s+domain"),
    ("proprietary", "reserved", r"all\s+rights\s+reserved"),
    ("proprietary", "proprietary", r"proprietary\s+and\s+confidential"),
)

#: What stands in a notice between a licence's name and its version.
PUBLISHED = r"\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[,;:]?\s+either\s+version\s+"
NAMED = rf"(?:gnu|the)\s+general\s+public\s+licen[sc]e{PUBLISHED}"
BEGUN = r"this\s+program\s+is\s+free\s+software[;:]\s+you\s+can\s+redistribute(?:(?!lesser|library|affero)[^\x00]){0,300}?either\s+version\s+"

#: Sentences of licences' own texts and notices: label, keyword, pattern. A version in a notice counts with the licence's name before it only.
TEXTS = (
    ("mit", "hereby", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge"),
    ("mit", "substantial", r"(?:shall\s+be\s+included\s+in|included\s+in)\s+all\s+copies\s+or\s+substantial\s+portions\s+of\s+the\s+software"),
    ("bsl-1.0", "organization", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy"),
    ("bsd", "redistribution", r"redistributions?\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("bsd", "reproduce", r"redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright"),
    ("bsd-3-clause", "endorse", r"may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products\s+derived"),
    ("bsd-4-clause", "advertising", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software"),
    ("bsd", "contributors", r"this\s+software\s+is\s+provided\s+by\s+the\s+(?:copyright\s+holders\s+and\s+contributors|regents\s+and\s+contributors)"),
    ("isc", "distribute", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:\s*/\s*or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("postgresql", "documentation", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose"),
    ("apache-2.0", "applicable", r"unless\s+required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing,\s+software\s+distributed\s+under\s+the\s+license"),
    ("apache-2.0", "compliance", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license"),
    ("apache-1.1", "foundation", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation"),
    ("gpl", "redistribute", r"this\s+program\s+is\s+free\s+software[;:]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("lgpl", "redistribute", r"this\s+library\s+is\s+free\s+software[;:]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("gpl-2.0", "either", rf"{NAMED}2\s+of\s+the\s+licen[sc]e"),
    ("gpl-3.0", "either", rf"{NAMED}3\s+of\s+the\s+licen[sc]e"),
    ("lgpl-2.0", "published", rf"library\s+general\s+public\s+licen[sc]e{PUBLISHED}2\s+of\s+the\s+licen[sc]e"),
    ("lgpl-2.1", "published", rf"lesser\s+general\s+public\s+licen[sc]e{PUBLISHED}2\.1\s+of\s+the\s+licen[sc]e"),
    ("lgpl-3.0", "published", rf"lesser\s+general\s+public\s+licen[sc]e{PUBLISHED}3\s+of\s+the\s+licen[sc]e"),
    ("agpl-3.0", "published", rf"affero\s+general\s+public\s+licen[sc]e{PUBLISHED}3\s+of\s+the\s+licen[sc]e"),
    ("gpl", "hope", r"distributed\s+in\s+the\s+hope\s+that\s+it\s+will\s+be\s+useful,?\s+but\s+without\s+any\s+warranty"),
    ("agpl-3.0", "remotely", r"all\s+users\s+interacting\s+with\s+it\s+remotely\s+through\s+a\s+computer\s+network"),
    ("gfdl", "invariant", r"with\s+no\s+invariant\s+sections"),
    ("mpl-2.0", "mozilla", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public"),
    ("mpl-1.1", "mozilla", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public"),
    ("epl", "accompanying", r"this\s+program\s+and\s+the\s+accompanying\s+materials\s+are\s+made\s+available\s+under"),
    ("cddl-1.0", "subject", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development"),
    ("zlib", "plainly", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("zlib", "origin", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("unlicense", "unencumbered", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("wtfpl", "verbatim", r"everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+or\s+modified\s+copies"),
    ("cc0-1.0", "waived", r"waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights"),
    ("openssl", "openssl", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project"),
    ("python-2.0", "licensee", r"psf\s+is\s+making\s+python(?:\s+[\w.]+)?\s+available\s+to\s+licensee"),
    ("ofl-1.1", "font", r"the\s+font\s+software,?\s+including\s+any\s+derivative\s+works"),
    ("artistic", "package", r"the\s+intent\s+of\s+this\s+document\s+is\s+to\s+state\s+the\s+conditions\s+under\s+which\s+a\s+package"),
)

#: Notices that tell a version by how they begin: label, keyword, pattern. They are weaker than sentences, which stay beside them.
NOTICES = (
    ("gpl-2.0", "either", rf"{BEGUN}2\s+of\s+the\s+licen[sc]e"),
    ("gpl-3.0", "either", rf"{BEGUN}3\s+of\s+the\s+licen[sc]e"),
)

#: Texts with none of these are not matched at all; each rule's matches hold one of them. Patterns take any white space
#: between words, so gates and keywords are single words, or name each character that may stand between.
GATES = ("licen", "spdx", "rights", "creative", "cc0", *(f"cc{c}by" for c in " \t\n\x0b\f\r-"), "domain", "proprietary", "opensource.org", "apache.org", "gnu.org", "mozilla.org", "eclipse.org", "joinup.ec", "boost.org", "libpng.org", "wtfpl", "postgresql.org", "mariadb.com", "mongodb.com", "scripts.sil.org", "spdx.org", "opendatacommons.org", "attribution", "hereby", "substantial", "redistribut", "endorse", "advertising", "contributors", "distribute", "applicable", "compliance", "apache", "hope", "remotely", "invariant", "mozilla", "accompanying", "subject", "plainly", "origin", "unencumbered", "verbatim", "waived", "openssl", "font", "package")

#: Score of the best detection by its priority.
SCORES = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.4}


def rules() -> list[Rule]:
    """All signatures in order: five forms for each family, sentences of licences' texts, then the clues."""
    grant = r"(?:licen[sc]ed|released|distributed|available|provided|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?"
    end = r"(?![\w.+-]*\w)"
    found = []
    for label, spdx, name, literal, address, host in FAMILIES:
        found += [
            Rule(label, 1, "spdx", rf"spdx-license-identifier:\s*{spdx}{end}"),
            Rule(label, 2, "under", rf"\b{grant}{name}\b"),
            Rule(label, 3, host, rf"(?:https?://)?(?:www\.)?{address}"),
            Rule(label, 3, "licen", rf"\blicen[sc]e[\"']?\s*[:=]\s*[\"']?{spdx}{end}"),
            Rule(label, 4, literal, rf"\b{name}\b"),
        ]
    found += [Rule(label, 3, keyword, rf"\b{pattern}\b") for label, keyword, pattern in TEXTS]
    found += [Rule(label, 4, keyword, rf"\b{pattern}\b") for label, keyword, pattern in NOTICES]
    return found + [Rule(label, 5, keyword, rf"\b{pattern}\b" if not pattern.startswith(r"\b") else pattern) for label, keyword, pattern in CLUES]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(low: Column, n_words: Column) -> Column:
    """Per phrase: label, places, first and last word, from one normalised text of words and single blanks."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NOT_WORD, " ")), F.lit(" "))
    parts = []
    for phrase, label in BASE_PHRASES:
        cut = F.split(plain, f"(?<= ){phrase}(?= )", -1)
        last = n_words - (_spaces(F.element_at(cut, -1)) - 1) - len(phrase.split())
        parts.append(F.struct(F.lit(label).alias("label"), (F.size(cut) - 1).cast("long").alias("n"), (_spaces(F.element_at(cut, 1)) - 1).cast("long").alias("first"), last.cast("long").alias("last")))
    return F.filter(F.array(*parts), lambda p: p["n"] > 0)


def detections(rows: DataFrame, low: str = "_low", table: list[Rule] | None = None) -> Column:
    """Array of ``rule, label, priority, gaps, lens``: per matching rule the texts' lengths between and in its matches."""
    table = rules() if table is None else table
    known = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(table)])
    text = F.col(low)
    gated = F.filter(known, lambda r: F.contains(text, r["keyword"]) & F.rlike(text, r["pattern"]))  # texts that don't match are scanned once
    matched = F.transform(
        gated,
        lambda r: F.struct(
            r["rule"].alias("rule"),
            r["label"].alias("label"),
            r["priority"].alias("priority"),
            F.transform(F.split(text, r["pattern"], -1), lambda x: F.length(x)).alias("gaps"),
            F.transform(F.regexp_extract_all(text, r["pattern"], F.lit(0)), lambda x: F.length(x)).alias("lens"),
        ),
    )
    return F.filter(matched, lambda m: F.size(m["lens"]) > 0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per document: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    A-Z are lower-cased and words are runs of digits, letters a-z and all characters beyond
    ASCII. ``n_base`` counts all places where a base phrase's words stand consecutively;
    ``first_word`` and ``last_word`` are their smallest and largest first words, from 0, else
    null. Texts that hold a gate word are matched against the signatures whose keyword they
    hold. A detection is suppressed if one of the same or a better priority covers it (of equal
    ones the earlier rule stays). ``labels`` joins the remaining ones' labels with the base
    ones, which always stay; ``score`` is that of the best remaining priority. ``spans`` are
    the remaining ``start, end, label, priority`` in characters, in order.

    A null or empty text has no words, empty labels, no spans and score 0. Repeated rows each
    come back. An empty table gives no rows; further columns are ignored. Detections meet again by
    id and text hash, rows that repeat both being folded to a number, so a lost executor's rows
    find their place again. Only one small row per document and one per detection are shuffled.
    """
    raw = docs.select(F.struct(F.col(id_col).alias("id"), F.md5(plain_text(text_col)).alias("text")).alias("_row"), plain_text(text_col).alias("_text"))
    low = raw.withColumn("n_words", F.size(F.regexp_extract_all("_text", F.lit(WORD_ANY_CASE), F.lit(0))).cast("long")).withColumn("_low", F.translate("_text", UPPER, LOWER))
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(F.col("_low"), F.lit(word))
    nothing = F.array().cast("array<struct<rule:int,label:string,priority:int,gaps:array<int>,lens:array<int>>>")
    no_base = F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")
    scanned = low.select(
        "_row",
        "n_words",
        F.when(F.contains(F.col("_low"), F.lit("license")), _base(F.col("_low"), F.col("n_words"))).otherwise(no_base).alias("_base"),
        F.when(gate, detections(low, "_low", table)).otherwise(nothing).alias("_found"),
    )
    per_rule = scanned.select("*", F.explode_outer("_found").alias("_f")).select("_row", "n_words", "_base", "_f.rule", "_f.label", "_f.priority", F.posexplode_outer(F.arrays_zip(F.col("_f.gaps").alias("gap"), F.col("_f.lens").alias("len"))).alias("_i", "_m"))
    per_rule = per_rule.select("*", "_m.gap", "_m.len").where("len IS NOT NULL OR rule IS NULL")
    same = ["n_words", "_base", "label", "priority", "gap", "len"]
    per_rule = per_rule.repartition("_row").groupBy("_row", "rule", "_i").agg(*[F.first(c).alias(c) for c in same], F.count(F.lit(1)).alias("_times"))
    along = Window.partitionBy("_row", "rule").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = per_rule.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along)).withColumn("start", F.col("end") - F.col("len"))
    order = Window.partitionBy("_row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    covers = [F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order) for p in sorted(SCORES)]
    cover = F.coalesce(*[F.when(F.col("priority") == p, c) for p, c in zip(sorted(SCORES), covers, strict=True)])
    judged = placed.withColumn("_out", F.coalesce(cover >= F.col("end"), F.lit(False)))
    kept = ~F.col("_out") & F.col("rule").isNotNull()
    grouped = judged.groupBy("_row").agg(
        F.max("_times").alias("_times"),
        F.first("n_words").alias("n_words"),
        F.first("_base").alias("_base"),
        F.collect_set(F.when(kept, F.col("label"))).alias("_labels"),
        F.min(F.when(kept, F.col("priority"))).alias("_best"),
        F.sort_array(F.collect_list(F.when(kept, F.struct("start", "end", "label", "priority")))).alias("spans"),
    )
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"])))
    best = F.coalesce(*[F.when(F.col("_best") == p, F.lit(s)) for p, s in SCORES.items()], F.lit(0.0))
    found = grouped.select(
        F.col("_row.id").alias(id_col),
        "n_words",
        F.aggregate("_base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.col("_labels")))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, F.lit(SCORES[5])).otherwise(F.lit(0.0))).alias("score"),
        "spans",
        "_times",
    )
    return repeated(found, "_times")
