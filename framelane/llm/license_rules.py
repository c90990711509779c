"""Hand-written signature rules of licences, over lower-cased words joined by single spaces.

A family has a label, the words that gate it, the pattern of its name, the pattern of its
SPDX identifier and that of its address. Each pattern is tried in the forms below, so a
family gives up to four rules; their priorities decide which of overlapping finds stand.
"""

from __future__ import annotations

from dataclasses import dataclass

LICENCE = "licen[cs]e"
V = "(?:v|ver|version)?(?: )?"
GRANT = "(?:licen[cs]ed|released|distributed|published|available|provided|made available|redistributed|dual licen[cs]ed|covered|governed)"

#: label, gate words, name, SPDX identifier, address
FAMILIES: list[tuple[str, tuple[str, ...], str, str, str]] = [
    ("mit", ("mit licen", "expat", "x11 licen", "licenses mit", "identifier mit"), f"(?:the )?(?:mit|expat|mit expat)(?: x11)? {LICENCE}", "mit", "opensource org licenses mit(?: php)?"),
    ("mit-0", ("mit no attribution", "mit 0"), "mit no attribution", "mit 0", "opensource org licenses mit 0"),
    ("apache-2.0", ("apache",), f"apache (?:software )?{LICENCE}(?: 2 0| {V}2(?: 0)?)?|apache 2 0", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", ("apache",), f"apache (?:software )?{LICENCE} {V}1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-1.0", ("apache",), f"apache (?:software )?{LICENCE} {V}1 0", "apache 1 0", "apache org licenses license 1 0"),
    ("bsd-2-clause", ("bsd", "freebsd"), f"(?:simplified|freebsd|2 clause|two clause) bsd(?: {LICENCE})?|bsd 2 clause(?: {LICENCE})?|freebsd {LICENCE}", "bsd 2 clause(?: freebsd)?", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", ("bsd",), f"(?:new|modified|revised|3 clause|three clause) bsd(?: {LICENCE})?|bsd 3 clause(?: {LICENCE})?", "bsd 3 clause(?: clear)?", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", ("bsd",), f"(?:original|old|4 clause|four clause) bsd(?: {LICENCE})?|bsd 4 clause(?: {LICENCE})?", "bsd 4 clause(?: uc)?", "spdx org licenses bsd 4 clause"),
    ("bsd", ("bsd",), f"(?:the )?bsd(?: style)? {LICENCE}", "bsd", "opensource org licenses bsd license"),
    ("0bsd", ("zero clause", "0bsd"), f"zero clause bsd(?: {LICENCE})?|bsd zero clause(?: {LICENCE})?", "0bsd", "opensource org licenses 0bsd"),
    ("isc", ("isc",), f"isc {LICENCE}", "isc", "opensource org licenses isc"),
    ("gpl-1.0", ("general public", "gpl", "gnu"), f"(?:gnu )?(?:general public {LICENCE}|gpl)(?: gpl)? {V}1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", ("general public", "gpl", "gnu"), f"(?:gnu )?(?:general public {LICENCE}|gpl)(?: gpl)? {V}2(?: 0)?|gplv2", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", ("general public", "gpl", "gnu"), f"(?:gnu )?(?:general public {LICENCE}|gpl)(?: gpl)? {V}3(?: 0)?|gplv3", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", ("general public", "gpl"), f"(?:gnu )?general public {LICENCE}|gnu gpl", "gpl", "gnu org (?:licenses|copyleft) gpl"),
    ("lgpl-2.0", ("lesser", "library general", "lgpl"), f"(?:gnu )?(?:library general public {LICENCE}|lgpl) {V}2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", ("lesser", "lgpl"), f"(?:gnu )?(?:lesser general public {LICENCE}|lgpl)(?: lgpl)? {V}2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", ("lesser", "lgpl"), f"(?:gnu )?(?:lesser general public {LICENCE}|lgpl)(?: lgpl)? {V}3(?: 0)?|lgplv3", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", ("lesser", "library general", "lgpl"), f"(?:gnu )?(?:lesser|library) general public {LICENCE}|gnu lgpl", "lgpl", "gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("agpl-1.0", ("affero", "agpl"), f"affero general public {LICENCE} {V}1(?: 0)?", "agpl 1 0(?: only| or later)?", "affero org oagpl"),
    ("agpl-3.0", ("affero", "agpl"), f"(?:gnu )?(?:affero general public {LICENCE}|agpl)(?: agpl)? {V}3(?: 0)?|agplv3", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl", ("affero", "agpl"), f"(?:gnu )?affero (?:general public )?{LICENCE}|gnu agpl", "agpl", "gnu org licenses agpl"),
    ("gfdl-1.1", ("free documentation", "gfdl"), f"(?:gnu )?(?:free documentation {LICENCE}|gfdl) {V}1 1", "gfdl 1 1(?: only| or later)?", "gnu org licenses (?:old licenses )?fdl 1 1"),
    ("gfdl-1.2", ("free documentation", "gfdl"), f"(?:gnu )?(?:free documentation {LICENCE}|gfdl) {V}1 2", "gfdl 1 2(?: only| or later)?", "gnu org licenses (?:old licenses )?fdl 1 2"),
    ("gfdl-1.3", ("free documentation", "gfdl"), f"(?:gnu )?(?:free documentation {LICENCE}|gfdl) {V}1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3"),
    ("gfdl", ("free documentation", "gfdl"), f"(?:gnu )?free documentation {LICENCE}|gnu fdl", "gfdl", "gnu org (?:licenses|copyleft) fdl"),
    ("mpl-1.0", ("mozilla", "mpl"), f"(?:mozilla public {LICENCE}|mpl) {V}1 0", "mpl 1 0", "mozilla org mpl mpl 1 0"),
    ("mpl-1.1", ("mozilla", "mpl"), f"(?:mozilla public {LICENCE}|mpl) {V}1 1", "mpl 1 1", "mozilla org mpl mpl 1 1"),
    ("mpl-2.0", ("mozilla", "mpl"), f"(?:mozilla public {LICENCE}|mpl)(?: mpl)? {V}2(?: 0)?", "mpl 2 0(?: no copyleft exception)?", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl", ("mozilla",), f"mozilla public {LICENCE}", "mpl", "mozilla org (?:en us )?mpl"),
    ("epl-1.0", ("eclipse", "epl"), f"(?:eclipse public {LICENCE}|epl)(?: epl)? {V}1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", ("eclipse", "epl"), f"(?:eclipse public {LICENCE}|epl)(?: epl)? {V}2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("edl-1.0", ("eclipse distribution", "edl"), f"eclipse distribution {LICENCE}", "edl 1 0", "eclipse org org documents edl v10"),
    ("cpl-1.0", ("common public", "cpl"), f"common public {LICENCE}", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("cddl-1.0", ("cddl", "common development"), f"(?:common development and distribution {LICENCE}|cddl)(?: cddl)?(?: {V}1 0)?", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cddl-1.1", ("cddl", "common development"), f"(?:common development and distribution {LICENCE}|cddl)(?: cddl)? {V}1 1", "cddl 1 1", "spdx org licenses cddl 1 1"),
    ("eupl-1.1", ("european union public", "eupl"), f"(?:european union public {LICENCE}|eupl)(?: eupl)? {V}1 1", "eupl 1 1", "spdx org licenses eupl 1 1"),
    ("eupl-1.2", ("european union public", "eupl"), f"(?:european union public {LICENCE}|eupl)(?: eupl)?(?: {V}1 2)?", "eupl 1 2", "joinup ec europa eu (?:collection eupl|software page eupl)"),
    ("artistic-1.0", ("artistic",), f"artistic {LICENCE} {V}1(?: 0)?", "artistic 1 0(?: perl| cl8)?", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", ("artistic",), f"artistic {LICENCE} {V}2(?: 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("artistic", ("artistic",), f"(?:perl )?artistic {LICENCE}", "artistic", "perlfoundation org artistic"),
    ("bsl-1.0", ("boost", "bsl"), f"boost software {LICENCE}(?: {V}1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", ("business source", "busl"), f"business source {LICENCE}(?: {V}1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("sspl-1.0", ("server side public", "sspl"), f"server side public {LICENCE}", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", ("elastic",), f"elastic {LICENCE}(?: {V}2(?: 0)?)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("unlicense", ("unlicense", "free and unencumbered"), "(?:the )?unlicense|free and unencumbered software released into the public domain", "unlicense", "unlicense org"),
    ("wtfpl", ("wtfpl", "what the f"), "wtfpl|do what the f[a-z]+ you want to public license", "wtfpl", "(?:sam zoy org|wtfpl net)"),
    ("zlib", ("zlib",), f"zlib(?: libpng)? {LICENCE}", "zlib", "opensource org licenses zlib"),
    ("libpng", ("libpng",), f"libpng {LICENCE}", "libpng(?: 2 0)?", "libpng org pub png src libpng license"),
    ("openssl", ("openssl",), f"openssl {LICENCE}", "openssl", "openssl org source license"),
    ("psf-2.0", ("python software", "psf"), f"(?:python software foundation|psf) {LICENCE}", "psf 2 0|python 2 0", "docs python org license"),
    ("php-3.01", ("php",), f"php {LICENCE}(?: {V}3 01?)?", "php 3 01?", "php net license"),
    ("ruby", ("ruby",), f"ruby {LICENCE}", "ruby", "ruby lang org en (?:about )?license"),
    ("postgresql", ("postgresql",), f"postgresql {LICENCE}", "postgresql", "postgresql org about licence"),
    ("ofl-1.1", ("open font", "ofl"), f"(?:sil )?open font {LICENCE}(?: {V}1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("ncsa", ("ncsa",), f"(?:university of illinois )?ncsa(?: open source)? {LICENCE}", "ncsa", "opensource org licenses ncsa"),
    ("ms-pl", ("microsoft public", "ms pl"), f"microsoft public {LICENCE}", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), f"microsoft reciprocal {LICENCE}", "ms rl", "opensource org licenses ms rl"),
    ("afl-3.0", ("academic free", "afl"), f"academic free {LICENCE}(?: {V}3(?: 0)?)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl-3.0", ("open software", "osl"), f"open software {LICENCE}(?: {V}3(?: 0)?)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("cecill-2.1", ("cecill",), f"cecill(?: {LICENCE})?(?: {V}2 1)?", "cecill 2 1", "cecill info licences"),
    ("mulan-2.0", ("mulan",), f"mulan (?:psl|permissive software {LICENCE})(?: {V}2)?", "mulanpsl 2 0", "license coscl org cn mulanpsl2"),
    ("upl-1.0", ("universal permissive", "upl"), f"universal permissive {LICENCE}", "upl 1 0", "opensource org licenses upl"),
    ("qpl-1.0", ("q public", "qpl"), f"q public {LICENCE}", "qpl 1 0", "opensource org licenses qpl"),
    ("ipl-1.0", ("ibm public", "ipl"), f"ibm public {LICENCE}", "ipl 1 0", "opensource org licenses ipl"),
    ("w3c", ("w3c",), f"w3c(?: software)?(?: notice and)? {LICENCE}", "w3c", "w3 org consortium legal"),
    ("odbl-1.0", ("open database", "odbl"), f"open (?:data commons open )?database {LICENCE}", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("pddl-1.0", ("public domain dedication", "pddl"), f"(?:open data commons )?public domain dedication and {LICENCE}", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("odc-by-1.0", ("open data commons", "odc by"), f"open data commons attribution {LICENCE}", "odc by 1 0", "opendatacommons org licenses by"),
    ("ogl-uk-3.0", ("open government",), f"open government {LICENCE}(?: {V}3(?: 0)?)?", "ogl uk 3 0", "nationalarchives gov uk doc open government licence"),
    ("openrail", ("openrail", "responsible ai"), f"(?:creativeml )?open ?rail(?: m)?(?: {LICENCE})?|responsible ai {LICENCE}", "openrail", "bigscience huggingface co blog the bigscience rail license"),
    ("cc0-1.0", ("cc0", "creative commons zero", "publicdomain zero"), "cc0(?: 1 0)?|creative commons zero(?: 1 0)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", ("public domain",), "(?:released|placed|dedicated) (?:into|in|to) the public domain|(?:in|under) the public domain", "public domain", "creativecommons org (?:licenses publicdomain|publicdomain mark)"),
]
#: Creative Commons: element words of the deeds; each has versions below.
CC_ELEMENTS = (
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nd", "attribution no ?deriv(?:ative|ative work)s?"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|ative work)s?"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: label, gate words, pattern: notices that name no licence
NOTICES = (
    ("copyright", ("copyright",), "copyright (?:c |© )?(?:19|20)[0-9]{2}"),
    ("warranty-disclaimer", ("warranty", "warranties"), "without warrant(?:y|ies) of any kind|as is without (?:any )?warrant(?:y|ies)|disclaims? all warranties"),
    ("permission-notice", ("permission is hereby",), "permission is hereby granted(?: free of charge)?"),
    ("redistribution-notice", ("redistribution and use",), "redistribution and use in source and binary forms"),
    ("no-redistribution", ("may not be",), "may not be (?:copied|reproduced|redistributed|distributed)"),
    ("proprietary", ("proprietary", "confidential"), "proprietary and confidential|confidential and proprietary"),
    ("permission-required", ("permission",), "(?:used|reprinted|reproduced) (?:by|with) permission|without (?:prior )?(?:written )?permission"),
    ("terms-of-use", ("terms of", "terms and conditions"), "subject to (?:the )?terms (?:of (?:use|service)|and conditions)"),
)
#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_PRIORITY = 6


@dataclass(frozen=True)
class Rule:
    label: str
    gates: tuple[str, ...]
    pattern: str
    priority: int
    base: bool = False


def rules() -> list[Rule]:
    """All rules in order; of equal finds the earlier rule wins."""
    out = [Rule(label, (f" {phrase} ",), phrase, BASE_PRIORITY, True) for phrase, label in BASE]
    families = list(FAMILIES)
    for short, words in CC_ELEMENTS:
        tag = short.replace("-", " ")
        name = f"(?:creative commons {words}|creative commons {tag}|cc {tag})(?: {LICENCE})?"
        families += [
            (f"cc-{short}-{v.replace(' ', '.')}", ("creative commons", " cc by", "creativecommons", "identifier cc"), f"{name}(?: {V}{v}| {v}(?: international| unported| generic))", f"cc {tag} {v}", f"creativecommons org licenses {tag} {v}")
            for v in CC_VERSIONS
        ]
        families.append((f"cc-{short}", ("creative commons", " cc by", "creativecommons"), name, f"cc {tag}", f"creativecommons org licenses {tag}"))
    for label, gates, name, tag, address in families:
        out.append(Rule(label, (*gates, "spdx"), f"spdx {LICENCE} identifier (?:{tag})", 10))
        out.append(Rule(label, (*gates, address.split(" ")[0].lstrip("(?:")), f"(?:https? )?(?:www )?(?:{address})", 9))
        out.append(Rule(label, gates, f"(?:is |are )?{GRANT} under (?:the )?(?:terms of )?(?:the )?(?:{name})", 8))
        out.append(Rule(label, gates, f"(?:{name})", 7 if label[-1:].isdigit() else 6))
    out += [Rule(label, gates, pattern, 3) for label, gates, pattern in NOTICES]
    return out
