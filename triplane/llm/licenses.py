"""License scan: ordered signature rules, gated by keywords, resolved by priority and interval containment.

A rule is (rule, licence, priority, keywords, pattern). One automaton over the lower-cased text finds which keywords occur;
a rule's regular expression runs only if one of its keywords does. Every match of a rule holds one of its keywords: the tests
prove it by expanding each pattern's alternatives. Detections are taken by priority, then length, then
place, then rule order; one whose interval lies within that of a detection already taken, or contains it, is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm.tables import arrow_batches

S = r"[\s*#/]{1,6}"  # white space, also across comment margins
V = rf"(?:,?{S}(?:version{S}|v\.?\s?))"

#: Licence names: (licence, pattern of its name, keywords, one of which every match has, in lower case).
NAMES: list[tuple[str, str, tuple[str, ...]]] = [
    ("AGPL-3.0", rf"(?:GNU{S})?(?:Affero{S}General{S}Public{S}Licen[sc]e|AGPL)(?:{V}3(?:\.0)?|-?v?3(?:\.0)?\b)", ("affero", "agpl")),
    ("AGPL-1.0", rf"Affero{S}General{S}Public{S}Licen[sc]e{V}1(?:\.0)?\b", ("affero",)),
    ("LGPL-3.0", rf"(?:GNU{S})?(?:Lesser{S}General{S}Public{S}Licen[sc]e|LGPL)(?:{V}3(?:\.0)?|-?v?3(?:\.0)?\b)", ("lesser", "lgpl")),
    ("LGPL-2.1", rf"(?:GNU{S})?(?:Lesser{S}General{S}Public{S}Licen[sc]e|LGPL)(?:{V}2\.1|-?v?2\.1\b)", ("lesser", "lgpl")),
    ("LGPL-2.0", rf"(?:GNU{S})?(?:Library{S}General{S}Public{S}Licen[sc]e|LGPL)(?:{V}2(?:\.0)?|-?v?2(?:\.0)?\b(?!\.1))", ("library", "lgpl")),
    ("GPL-3.0", rf"(?:GNU{S}General{S}Public{S}Licen[sc]e|(?<![AL])\bGPL)(?:{V}3(?:\.0)?|-?v?3(?:\.0)?\b)", ("general", "gpl")),
    ("GPL-2.0", rf"(?:GNU{S}General{S}Public{S}Licen[sc]e|(?<![AL])\bGPL)(?:{V}2(?:\.0)?|-?v?2(?:\.0)?\b)", ("general", "gpl")),
    ("GPL-1.0", rf"(?:GNU{S}General{S}Public{S}Licen[sc]e|(?<![AL])\bGPL)(?:{V}1(?:\.0)?|-?v?1(?:\.0)?\b)", ("general", "gpl")),
    ("GFDL-1.3", rf"GNU{S}Free{S}Documentation{S}Licen[sc]e{V}1\.3", ("documentation",)),
    ("GFDL-1.2", rf"GNU{S}Free{S}Documentation{S}Licen[sc]e{V}1\.2", ("documentation",)),
    ("GFDL-1.1", rf"GNU{S}Free{S}Documentation{S}Licen[sc]e{V}1\.1", ("documentation",)),
    ("Apache-2.0", rf"Apache(?:{S}Software)?{S}Licen[sc]e(?:{V}2(?:\.0)?|{S}2(?:\.0)?\b)|Apache-2\.0", ("apache",)),
    ("Apache-1.1", rf"Apache(?:{S}Software)?{S}Licen[sc]e{V}1\.1|Apache-1\.1", ("apache",)),
    ("Apache-1.0", rf"Apache(?:{S}Software)?{S}Licen[sc]e{V}1\.0|Apache-1\.0", ("apache",)),
    ("MIT", rf"\bMIT{S}(?:\(Expat\){S})?Licen[sc]e|\bExpat{S}Licen[sc]e", ("mit", "expat")),
    ("MIT-0", rf"\bMIT{S}No{S}Attribution|\bMIT-0\b", ("mit",)),
    ("X11", rf"\bX11{S}Licen[sc]e", ("x11",)),
    ("ISC", rf"\bISC{S}Licen[sc]e", ("isc",)),
    ("BSD-4-Clause", rf"(?:4|four)[-\s]clause{S}BSD|BSD{S}4[-\s]Clause|original{S}BSD{S}Licen[sc]e", ("bsd",)),
    ("BSD-3-Clause", rf"(?:3|three)[-\s]clause{S}BSD|BSD{S}3[-\s]Clause|(?:new|revised|modified){S}BSD{S}Licen[sc]e", ("bsd",)),
    ("BSD-2-Clause", rf"(?:2|two)[-\s]clause{S}BSD|BSD{S}2[-\s]Clause|(?:simplified|FreeBSD){S}(?:BSD{S})?Licen[sc]e", ("bsd", "simplified")),
    ("BSD-1-Clause", rf"(?:1|one)[-\s]clause{S}BSD|BSD{S}1[-\s]Clause", ("bsd",)),
    ("0BSD", rf"zero[-\s]clause{S}BSD|\b0BSD\b", ("bsd",)),
    ("MPL-2.0", rf"Mozilla{S}Public{S}Licen[sc]e(?:{V}|{S})2(?:\.0)?|\bMPL[-\s]?v?2(?:\.0)?\b", ("mozilla", "mpl")),
    ("MPL-1.1", rf"Mozilla{S}Public{S}Licen[sc]e(?:{V}|{S})1\.1|\bMPL[-\s]?v?1\.1\b", ("mozilla", "mpl")),
    ("MPL-1.0", rf"Mozilla{S}Public{S}Licen[sc]e(?:{V}|{S})1\.0|\bMPL[-\s]?v?1\.0\b", ("mozilla", "mpl")),
    ("EPL-2.0", rf"Eclipse{S}Public{S}Licen[sc]e(?:{V}|{S}-?{S}?(?:v\s?)?)2(?:\.0)?|\bEPL[-\s]?v?2(?:\.0)?\b", ("eclipse", "epl")),
    ("EPL-1.0", rf"Eclipse{S}Public{S}Licen[sc]e(?:{V}|{S}-?{S}?(?:v\s?)?)1(?:\.0)?|\bEPL[-\s]?v?1(?:\.0)?\b", ("eclipse", "epl")),
    ("EDL-1.0", rf"Eclipse{S}Distribution{S}Licen[sc]e", ("eclipse",)),
    ("EUPL-1.2", rf"European{S}Union{S}Public{S}Licen[sc]e(?:{V}|{S})1\.2|\bEUPL[-\s]?v?1\.2\b", ("european", "eupl")),
    ("EUPL-1.1", rf"European{S}Union{S}Public{S}Licen[sc]e(?:{V}|{S})1\.1|\bEUPL[-\s]?v?1\.1\b", ("european", "eupl")),
    ("CDDL-1.1", rf"(?:Common{S}Development{S}and{S}Distribution{S}Licen[sc]e|\bCDDL)[\s,(]{{0,3}}(?:CDDL\)?\s?)?(?:version\s|v\.?)?1\.1", ("development", "cddl")),
    ("CDDL-1.0", rf"(?:Common{S}Development{S}and{S}Distribution{S}Licen[sc]e|\bCDDL)[\s,(]{{0,3}}(?:CDDL\)?\s?)?(?:version\s|v\.?)?1\.0", ("development", "cddl")),
    ("CPL-1.0", rf"Common{S}Public{S}Licen[sc]e", ("common",)),
    ("BSL-1.0", rf"Boost{S}Software{S}Licen[sc]e", ("boost",)),
    ("BUSL-1.1", rf"Business{S}Source{S}Licen[sc]e", ("business",)),
    ("Artistic-2.0", rf"Artistic{S}Licen[sc]e(?:{V}|{S})2(?:\.0)?", ("artistic",)),
    ("Artistic-1.0", rf"Artistic{S}Licen[sc]e(?:{V}|{S})1(?:\.0)?", ("artistic",)),
    ("Zlib", rf"\bzlib(?:/libpng)?{S}Licen[sc]e", ("zlib",)),
    ("Libpng", rf"\blibpng{S}Licen[sc]e", ("libpng",)),
    ("OpenSSL", rf"\bOpenSSL{S}Licen[sc]e", ("openssl",)),
    ("PHP-3.01", rf"\bPHP{S}Licen[sc]e(?:{V}|{S})3\.01", ("php",)),
    ("PHP-3.0", rf"\bPHP{S}Licen[sc]e(?:{V}|{S})3\.0\b", ("php",)),
    ("PSF-2.0", rf"Python{S}Software{S}Foundation{S}Licen[sc]e|\bPSF{S}Licen[sc]e", ("python", "psf")),
    ("CNRI-Python", rf"\bCNRI{S}(?:Python{S})?Licen[sc]e", ("cnri",)),
    ("Ruby", rf"\bRuby{S}Licen[sc]e|Ruby's{S}licen[sc]e", ("ruby",)),
    ("PostgreSQL", rf"\bPostgreSQL{S}Licen[sc]e", ("postgresql",)),
    ("NCSA", rf"University{S}of{S}Illinois/?(?:NCSA)?{S}Open{S}Source{S}Licen[sc]e|\bNCSA{S}(?:Open{S}Source{S})?Licen[sc]e", ("ncsa", "illinois")),
    ("W3C", rf"\bW3C{S}(?:Software{S})?(?:Notice{S}and{S})?Licen[sc]e", ("w3c",)),
    ("Unicode-DFS-2016", rf"\bUnicode{S}(?:Data{S}Files{S}and{S}Software{S})?(?:Terms|Licen[sc]e)", ("unicode",)),
    ("ICU", rf"\bICU{S}Licen[sc]e", ("icu",)),
    ("WTFPL", rf"\bWTFPL\b|Do{S}What{S}The{S}F\w*{S}You{S}Want{S}To{S}Public{S}Licen[sc]e", ("wtfpl", "want")),
    ("Unlicense", rf"\bthe{S}Unlicense\b|free{S}and{S}unencumbered{S}software{S}released{S}into{S}the{S}public{S}domain", ("unlicense", "unencumbered")),
    ("OFL-1.1", rf"SIL{S}Open{S}Font{S}Licen[sc]e(?:(?:{V}|{S})1\.1)?|\bOFL[-\s]?v?1\.1\b", ("font", "ofl")),
    ("OFL-1.0", rf"SIL{S}Open{S}Font{S}Licen[sc]e(?:{V}|{S})1\.0", ("font",)),
    ("ODbL-1.0", rf"Open{S}(?:Data{S}Commons{S}Open{S})?Database{S}Licen[sc]e|\bODbL\b", ("database", "odbl")),
    ("ODC-By-1.0", rf"Open{S}Data{S}Commons{S}Attribution{S}Licen[sc]e|\bODC-By\b", ("commons", "odc-by")),
    ("PDDL-1.0", rf"Public{S}Domain{S}Dedication{S}(?:and|&){S}Licen[sc]e|\bPDDL\b", ("dedication", "pddl")),
    ("OSL-3.0", rf"Open{S}Software{S}Licen[sc]e(?:{V}|{S})3(?:\.0)?|\bOSL[-\s]?3\.0\b", ("software", "osl")),
    ("AFL-3.0", rf"Academic{S}Free{S}Licen[sc]e(?:{V}|{S})3(?:\.0)?|\bAFL[-\s]?3\.0\b", ("academic", "afl")),
    ("AFL-2.1", rf"Academic{S}Free{S}Licen[sc]e(?:{V}|{S})2\.1|\bAFL[-\s]?2\.1\b", ("academic", "afl")),
    ("ECL-2.0", rf"Educational{S}Community{S}Licen[sc]e(?:(?:{V}|{S})2(?:\.0)?)?", ("educational",)),
    ("MS-PL", rf"Microsoft{S}Public{S}Licen[sc]e|\bMs-PL\b", ("microsoft", "ms-pl")),
    ("MS-RL", rf"Microsoft{S}Reciprocal{S}Licen[sc]e|\bMs-RL\b", ("microsoft", "ms-rl")),
    ("UPL-1.0", rf"Universal{S}Permissive{S}Licen[sc]e", ("universal",)),
    ("BlueOak-1.0.0", rf"Blue{S}Oak{S}Model{S}Licen[sc]e", ("oak",)),
    ("MulanPSL-2.0", rf"Mulan{S}(?:Permissive{S}Software{S}Licen[sc]e|PSL)(?:,?{S}(?:version{S}|v)2)?", ("mulan",)),
    ("QPL-1.0", rf"\bQ{S}Public{S}Licen[sc]e|\bQPL\b", ("public", "qpl")),
    ("RPL-1.5", rf"Reciprocal{S}Public{S}Licen[sc]e", ("reciprocal",)),
    ("SSPL-1.0", rf"Server{S}Side{S}Public{S}Licen[sc]e|\bSSPL\b", ("server", "sspl")),
    ("Elastic-2.0", rf"Elastic{S}Licen[sc]e(?:(?:{V}|{S})2(?:\.0)?)?", ("elastic",)),
    ("Vim", rf"\bVim{S}Licen[sc]e", ("vim",)),
    ("TCL", rf"\bTcl(?:/Tk)?{S}Licen[sc]e", ("tcl",)),
    ("HPND", rf"Historical{S}Permission{S}Notice{S}and{S}Disclaimer", ("historical",)),
    ("FTL", rf"Free[Tt]ype{S}(?:Project{S})?Licen[sc]e", ("freetype",)),
    ("IJG", rf"Independent{S}JPEG{S}Group(?:'s)?{S}(?:software|licen[sc]e)?", ("jpeg",)),
    ("IPL-1.0", rf"\bIBM{S}Public{S}Licen[sc]e", ("ibm",)),
    ("SPL-1.0", rf"\bSun{S}Public{S}Licen[sc]e", ("sun",)),
    ("NPL-1.1", rf"Netscape{S}Public{S}Licen[sc]e", ("netscape",)),
    ("APSL-2.0", rf"Apple{S}Public{S}Source{S}Licen[sc]e", ("apple",)),
    ("CeCILL-2.1", rf"\bCeCILL(?:{S}(?:Free{S}Software{S})?Licen[sc]e)?(?:{S}|-)?(?:v\.?)?2\.1", ("cecill",)),
    ("CeCILL-B", rf"\bCeCILL-B\b", ("cecill",)),
    ("CeCILL-C", rf"\bCeCILL-C\b", ("cecill",)),
    ("LPPL-1.3c", rf"LaTeX{S}Project{S}Public{S}Licen[sc]e|\bLPPL\b", ("latex", "lppl")),
    ("Beerware", rf"\bBeer-?ware{S}Licen[sc]e|THE{S}BEER-WARE{S}LICENSE", ("beer",)),
    ("JSON", rf"The{S}Software{S}shall{S}be{S}used{S}for{S}Good,?{S}not{S}Evil", ("evil",)),
    ("Hippocratic-2.1", rf"Hippocratic{S}Licen[sc]e", ("hippocratic",)),
    ("OpenRAIL-M", rf"\b(?:Open\s?RAIL(?:\+\+)?(?:-M|-S)?|Responsible{S}AI{S}Licen[sc]e)\b", ("rail", "responsible")),
    ("CC0-1.0", rf"\bCC0(?:[-\s]1\.0)?\b|Creative{S}Commons{S}(?:Zero|CC0)", ("cc0", "creative")),
    *[
        (f"CC-{code}-{v}", rf"\bCC[- ]{code.replace('-', '[-/ ]')}(?:[-\s]v?|{S}){re.escape(v)}|Creative{S}Commons{S}{name}(?:{S}\w+)?(?:,?{S}(?:version{S})?|-){re.escape(v)}", ("cc ", "cc-", "creative"))
        for code, name in (
            ("BY-NC-SA", rf"Attribution\s?-\s?Non-?Commercial\s?-\s?Share\s?-?Alike"),
            ("BY-NC-ND", rf"Attribution\s?-\s?Non-?Commercial\s?-\s?No\s?Deriv(?:ative)?s?"),
            ("BY-NC", rf"Attribution\s?-\s?Non-?Commercial"),
            ("BY-SA", rf"Attribution\s?-\s?Share\s?-?Alike"),
            ("BY-ND", rf"Attribution\s?-\s?No\s?Deriv(?:ative)?s?"),
            ("BY", rf"Attribution"),
        )
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0")
    ],
]

#: Texts and addresses of licences: (licence, pattern, keywords).
TEXTS: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", rf"Permission{S}is{S}hereby{S}granted,?{S}free{S}of{S}charge,?{S}to{S}any{S}person{S}obtaining{S}a{S}copy", ("hereby",)),
    ("ISC", rf"Permission{S}to{S}use,?{S}copy,?{S}modify,?{S}and/or{S}distribute{S}this{S}software", ("permission",)),
    ("BSD-2-Clause", rf"Redistribution{S}and{S}use{S}in{S}source{S}and{S}binary{S}forms", ("redistribution",)),
    ("BSD-3-Clause", rf"Neither{S}the{S}names?{S}of{S}[^\n]{{1,120}}?{S}nor{S}the{S}names?{S}of", ("neither",)),
    ("BSD-4-Clause", rf"All{S}advertising{S}materials{S}mentioning{S}features", ("advertising",)),
    ("Zlib", rf"This{S}software{S}is{S}provided{S}'as-is',?{S}without{S}any{S}express", ("as-is",)),
    ("BSL-1.0", rf"Permission{S}is{S}hereby{S}granted,?{S}free{S}of{S}charge,?{S}to{S}any{S}person{S}or{S}organi[sz]ation{S}obtaining", ("hereby",)),
    ("GPL-2.0-or-later", rf"either{S}version{S}2{S}of{S}the{S}Licen[sc]e,?{S}or{S}\(at{S}your{S}option\){S}any{S}later{S}version", ("option",)),
    ("GPL-3.0-or-later", rf"either{S}version{S}3{S}of{S}the{S}Licen[sc]e,?{S}or{S}\(at{S}your{S}option\){S}any{S}later{S}version", ("option",)),
    ("LGPL-2.1-or-later", rf"either{S}version{S}2\.1{S}of{S}the{S}Licen[sc]e,?{S}or{S}\(at{S}your{S}option\){S}any{S}later{S}version", ("option",)),
    ("MPL-2.0", rf"This{S}Source{S}Code{S}Form{S}is{S}subject{S}to{S}the{S}terms", ("source",)),
    ("Apache-2.0", rf"you{S}may{S}not{S}use{S}this{S}file{S}except{S}in{S}compliance{S}with{S}the{S}Licen[sc]e", ("compliance",)),
    ("EPL-1.0", rf"THE{S}ACCOMPANYING{S}PROGRAM{S}IS{S}PROVIDED{S}UNDER{S}THE{S}TERMS", ("accompanying",)),
    ("Artistic-2.0", rf"Everyone{S}is{S}permitted{S}to{S}copy{S}and{S}distribute{S}verbatim{S}copies{S}of{S}this{S}licen[sc]e", ("verbatim",)),
    ("GFDL-1.3", rf"with{S}no{S}Invariant{S}Sections", ("invariant",)),
    ("NCSA", rf"deal{S}with{S}the{S}Software{S}without{S}restriction", ("restriction",)),
    ("OpenSSL", rf"developed{S}by{S}the{S}OpenSSL{S}Project", ("openssl",)),
    ("Apache-1.1", rf"This{S}product{S}includes{S}software{S}developed{S}by{S}the{S}Apache{S}Software{S}Foundation", ("apache",)),
    ("MIT", rf"The{S}above{S}copyright{S}notice{S}and{S}this{S}permission{S}notice{S}shall{S}be{S}included", ("permission",)),
    ("MIT", rf"THE{S}SOFTWARE{S}IS{S}PROVIDED{S}[\"'“]?AS{S}IS[\"'”]?,?{S}WITHOUT{S}WARRANTY{S}OF{S}ANY{S}KIND", ("warranty",)),
    ("ISC", rf"THE{S}SOFTWARE{S}IS{S}PROVIDED{S}[\"'“]?AS{S}IS[\"'”]?{S}AND{S}THE{S}AUTHOR{S}DISCLAIMS", ("disclaims",)),
    ("BSD-2-Clause", rf"Redistributions{S}of{S}source{S}code{S}must{S}retain{S}the{S}above{S}copyright", ("redistributions",)),
    ("BSD-2-Clause", rf"Redistributions{S}in{S}binary{S}form{S}must{S}reproduce{S}the{S}above{S}copyright", ("redistributions",)),
    ("BSD-3-Clause", rf"may{S}be{S}used{S}to{S}endorse{S}or{S}promote{S}products{S}derived{S}from{S}this{S}software", ("endorse",)),
    ("BSD-4-Clause", rf"must{S}display{S}the{S}following{S}acknowledge?ment", ("acknowledg",)),
    ("GPL-2.0", rf"GNU{S}GENERAL{S}PUBLIC{S}LICENSE{S}Version{S}2,{S}June{S}1991", ("june",)),
    ("GPL-3.0", rf"GNU{S}GENERAL{S}PUBLIC{S}LICENSE{S}Version{S}3,{S}29{S}June{S}2007", ("june",)),
    ("AGPL-3.0", rf"GNU{S}AFFERO{S}GENERAL{S}PUBLIC{S}LICENSE{S}Version{S}3,{S}19{S}November{S}2007", ("affero",)),
    ("AGPL-3.0-or-later", rf"GNU{S}Affero{S}General{S}Public{S}Licen[sc]e{S}as{S}published{S}by{S}the{S}Free{S}Software{S}Foundation", ("affero",)),
    ("GPL-1.0-or-later", rf"free{S}software;{S}you{S}can{S}redistribute{S}it{S}and/or{S}modify{S}it{S}under{S}the{S}terms{S}of{S}the{S}GNU{S}General{S}Public", ("redistribute",)),
    ("LGPL-2.0-or-later", rf"free{S}software;{S}you{S}can{S}redistribute{S}it{S}and/or{S}modify{S}it{S}under{S}the{S}terms{S}of{S}the{S}GNU{S}(?:Lesser|Library){S}General", ("redistribute",)),
    ("LGPL-3.0", rf"incorporates{S}the{S}terms{S}and{S}conditions{S}of{S}version{S}3{S}of{S}the{S}GNU{S}General", ("incorporates",)),
    ("Apache-2.0", rf"distributed{S}under{S}the{S}Licen[sc]e{S}is{S}distributed{S}on{S}an{S}[\"'“]?AS{S}IS[\"'”]?{S}BASIS", ("basis",)),
    ("Apache-2.0", rf"TERMS{S}AND{S}CONDITIONS{S}FOR{S}USE,{S}REPRODUCTION,{S}AND{S}DISTRIBUTION", ("reproduction",)),
    ("MPL-2.0", rf"If{S}a{S}copy{S}of{S}the{S}MPL{S}was{S}not{S}distributed{S}with{S}this{S}file", ("mpl",)),
    ("MPL-1.1", rf"The{S}contents{S}of{S}this{S}file{S}are{S}subject{S}to{S}the{S}Mozilla{S}Public{S}Licen[sc]e{S}Version{S}1\.1", ("mozilla",)),
    ("EPL-2.0", rf"accompanying{S}materials{S}are{S}made{S}available{S}under{S}the{S}terms{S}of{S}the{S}Eclipse{S}Public{S}Licen[sc]e{S}2\.0", ("accompanying",)),
    ("CDDL-1.0", rf"The{S}contents{S}of{S}this{S}file{S}are{S}subject{S}to{S}the{S}terms{S}of{S}the{S}Common{S}Development{S}and{S}Distribution", ("development",)),
    ("Zlib", rf"The{S}origin{S}of{S}this{S}software{S}must{S}not{S}be{S}misrepresented", ("misrepresented",)),
    ("Zlib", rf"Altered{S}source{S}versions{S}must{S}be{S}plainly{S}marked{S}as{S}such", ("altered",)),
    ("Unlicense", rf"Anyone{S}is{S}free{S}to{S}copy,{S}modify,{S}publish,{S}use,{S}compile,{S}sell", ("anyone",)),
    ("CC0-1.0", rf"has{S}waived{S}all{S}copyright{S}and{S}related{S}or{S}neighboring{S}rights", ("neighboring",)),
    ("WTFPL", rf"You{S}just{S}DO{S}WHAT{S}THE{S}F\w*{S}YOU{S}WANT{S}TO", ("want",)),
    ("Beerware", rf"you{S}can{S}buy{S}me{S}a{S}beer{S}in{S}return", ("beer",)),
    ("PostgreSQL", rf"IN{S}NO{S}EVENT{S}SHALL{S}THE{S}UNIVERSITY{S}OF{S}CALIFORNIA{S}BE{S}LIABLE", ("california",)),
    ("PSF-2.0", rf"PSF{S}is{S}making{S}Python{S}available{S}to{S}Licensee", ("psf",)),
    ("OFL-1.1", rf"may{S}be{S}sold{S}by{S}itself,{S}unless{S}[^\n]{{0,40}}|Reserved{S}Font{S}Name", ("font", "itself")),
    ("Artistic-1.0", rf"The{S}intent{S}of{S}this{S}document{S}is{S}to{S}state{S}the{S}conditions{S}under{S}which{S}a{S}Package", ("intent",)),
    ("EUPL-1.2", rf"Licensed{S}under{S}the{S}EUPL", ("eupl",)),
    ("HPND", rf"Permission{S}to{S}use,{S}copy,{S}modify,?{S}and{S}distribute{S}this{S}software{S}and{S}its{S}documentation", ("permission",)),
    ("NTP", rf"Permission{S}to{S}use,{S}copy,{S}modify,{S}and{S}distribute{S}this{S}software{S}(?:and{S}its{S}documentation{S})?for{S}any{S}purpose{S}with(?:out)?{S}fee", ("permission",)),
    ("curl", rf"Permission{S}to{S}use,{S}copy,{S}modify,{S}and{S}distribute{S}this{S}software{S}for{S}any{S}purpose{S}with{S}or{S}without{S}fee", ("permission",)),
    ("MS-PL", rf"If{S}you{S}use{S}the{S}software,{S}you{S}accept{S}this{S}licen[sc]e", ("accept",)),
    ("UPL-1.0", rf"to{S}deal{S}in{S}both{S}\(a\){S}the{S}Software", ("deal",)),
    ("GFDL-1.1", rf"Permission{S}is{S}granted{S}to{S}copy,{S}distribute{S}and/or{S}modify{S}this{S}document", ("document",)),
    ("ODbL-1.0", rf"made{S}available{S}under{S}the{S}Open{S}Database{S}Licen[sc]e", ("database",)),
    ("SSPL-1.0", rf"making{S}the{S}functionality{S}of{S}the{S}Program{S}or{S}modified{S}version{S}available{S}to{S}third{S}parties{S}as{S}a{S}service", ("functionality",)),
    ("Elastic-2.0", rf"You{S}may{S}not{S}provide{S}the{S}software{S}to{S}third{S}parties{S}as{S}a{S}hosted{S}or{S}managed{S}service", ("hosted",)),
    ("BUSL-1.1", rf"(?:Additional{S}Use{S}Grant|Change{S}Date):", ("additional", "change")),
    ("OpenRAIL-M", rf"use-based{S}restrictions", ("use-based",)),
    ("Llama-2", rf"Llama{S}2{S}is{S}licensed{S}under{S}the{S}LLAMA{S}2{S}Community{S}Licen[sc]e", ("llama",)),
    *[(spdx, rf"(?:https?://)?(?:www\.)?{re.escape(url)}[\w./#-]{{0,80}}", (url.split("/")[0],)) for spdx, url in (
        ("Apache-2.0", "apache.org/licenses/LICENSE-2.0"), ("Apache-1.1", "apache.org/licenses/LICENSE-1.1"), ("GPL-3.0", "gnu.org/licenses/gpl-3.0"), ("GPL-2.0", "gnu.org/licenses/old-licenses/gpl-2.0"), ("LGPL-3.0", "gnu.org/licenses/lgpl-3.0"), ("LGPL-2.1", "gnu.org/licenses/old-licenses/lgpl-2.1"), ("AGPL-3.0", "gnu.org/licenses/agpl-3.0"), ("GFDL-1.3", "gnu.org/licenses/fdl-1.3"),
        ("MIT", "opensource.org/licenses/MIT"), ("ISC", "opensource.org/licenses/ISC"), ("BSD-3-Clause", "opensource.org/licenses/BSD-3-Clause"), ("BSD-2-Clause", "opensource.org/licenses/BSD-2-Clause"), ("MPL-2.0", "mozilla.org/MPL/2.0"), ("MPL-1.1", "mozilla.org/MPL/1.1"), ("EPL-2.0", "eclipse.org/legal/epl-2.0"), ("EPL-1.0", "eclipse.org/legal/epl-v10"), ("BSL-1.0", "boost.org/LICENSE_1_0"), ("Unlicense", "unlicense.org"), ("WTFPL", "wtfpl.net"), ("ODbL-1.0", "opendatacommons.org/licenses/odbl"), ("ODC-By-1.0", "opendatacommons.org/licenses/by"), ("PDDL-1.0", "opendatacommons.org/licenses/pddl"), ("OFL-1.1", "scripts.sil.org/OFL"), ("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"), ("public-domain", "creativecommons.org/publicdomain/mark/1.0"),
        *((f"CC-{c.upper()}-{v}", f"creativecommons.org/licenses/{c}/{v}") for c in ("by-nc-sa", "by-nc-nd", "by-nc", "by-sa", "by-nd", "by") for v in ("4.0", "3.0", "2.5", "2.0", "1.0")),
    )],
]

#: Phrases that speak of rights without naming a licence.
PHRASES: list[tuple[str, str, tuple[str, ...]]] = [
    ("all-rights-reserved", rf"\ball{S}rights{S}reserved\b", ("reserved",)),
    ("copyright", r"(?:\bcopyright\b|©|\(c\))[\s:]{0,3}(?:\(c\)|©)?\s{0,3}(?:19|20)\d\d(?:\s?[-–,]\s?(?:19|20)\d\d)*", ("copyright", "©", "(c)")),
    ("public-domain", rf"\b(?:in|into|to){S}the{S}public{S}domain\b", ("domain",)),
    ("proprietary", rf"\bproprietary{S}and{S}confidential\b|\bconfidential{S}and{S}proprietary\b", ("proprietary",)),
    ("no-redistribution", rf"\b(?:may|must|shall){S}not{S}be{S}(?:reproduced|redistributed|copied)\b", ("not",)),
    ("permission-required", rf"\bwithout{S}(?:the{S})?(?:prior{S})?(?:written{S})?permission\b", ("permission",)),
    ("non-commercial", rf"\b(?:for{S})?non-?commercial{S}(?:use|purposes?){S}only\b", ("commercial",)),
    ("freeware", rf"\bthis{S}(?:software|program){S}is{S}freeware\b", ("freeware",)),
    ("unnamed", rf"\b(?:licen[sc]ed|released|distributed|available|published){S}under{S}(?:the{S}terms{S}of{S})?(?:the{S}|an?{S})?[^.;\n]{{1,80}}?licen[sc]e", ("licensed", "released", "distributed", "available", "published", "licenced")),
]


def build_rules() -> list[tuple[str, str, int, tuple[str, ...], str]]:
    """All rules in order: SPDX tags, then licence notices, addresses and texts, names, phrases."""
    rules = []
    for licence, name, keys in NAMES:
        rules.append((f"spdx:{licence}", licence, 5, ("spdx",), rf"SPDX-License-Identifier:\s{{0,3}}{re.escape(licence)}(?![\w.])(?:-only|-or-later)?"))
        rules.append((f"notice:{licence}", licence, 4, keys, rf"\b(?:licen[sc]ed|released|distributed|available|published|provided|covered){S}under{S}(?:the{S}terms{S}of{S})?(?:the{S}|an?{S})?(?:{name})(?:{S}licen[sc]e)?"))
    rules += [(f"text:{n}:{licence}", licence, 3, keys, pattern) for n, (licence, pattern, keys) in enumerate(TEXTS)]
    rules += [(f"name:{licence}", licence, 2, keys, name) for licence, name, keys in NAMES]
    rules += [(f"phrase:{licence}", licence, 1, keys, pattern) for licence, pattern, keys in PHRASES]
    return rules


RULES = build_rules()
_ready: tuple | None = None


def _prepared() -> tuple:
    global _ready
    if _ready is None:
        import ahocorasick

        by_key: dict[str, list[int]] = {}
        for i, (_, _, _, keys, _) in enumerate(RULES):
            for key in keys:
                by_key.setdefault(key, []).append(i)
        automaton = ahocorasick.Automaton()
        for key, rules in by_key.items():
            automaton.add_word(key, key)
        automaton.make_automaton()
        _ready = automaton, by_key, [re.compile(pattern, re.IGNORECASE) for *_, pattern in RULES]
    return _ready


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections (rule, start, end) that stay, by start: see the module's first lines."""
    # of what is kept none contains another, so by start they are by end too: one look to each side finds any containment
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for rule, start, end in sorted(set(found), key=lambda d: (-RULES[d[0]][2], d[1] - d[2], d[1], d[0])):
        before, after = bisect_right(starts, start) - 1, bisect_left(starts, start)
        if before >= 0 and kept[before][2] >= end or after < len(kept) and kept[after][2] <= end:
            continue
        starts.insert(after, start)
        kept.insert(after, (rule, start, end))
    return kept


def fold(text: str) -> str:
    """text in lower case as regular expressions see it when they ignore case; lengths may differ."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def detect(text: str | None) -> list[tuple[int, int, int]]:
    """The resolved detections of one text; none for a null or empty one."""
    if not text:
        return []
    automaton, by_key, patterns = _prepared()
    keys = {key for _, key in automaton.iter(fold(text))}
    if not keys:
        return []
    rules = sorted({i for key in keys for i in by_key[key]})
    return resolve([(i, m.start(), m.end()) for i in rules for m in patterns[i].finditer(text) if m.end() > m.start()])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, license, priority, start, end, matched), a row for each detection that stays; start and end in
    characters. Rows of docs without any give none; repeated rows and null ids are scanned like others, long texts whole. No docs
    give no rows; other columns play no part. Map-only."""
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scanned(batches):
        for batch in batches:
            owner, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for rule, start, end in detect(text):
                    owner.append(i)
                    out.append((RULES[rule][0], RULES[rule][1], RULES[rule][2], start, end, text[start:end]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "rule", "license", "priority", "start", "end", "matched"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(scanned, f"doc_id {id_type}, rule string, license string, priority int, start long, end long, matched string")
