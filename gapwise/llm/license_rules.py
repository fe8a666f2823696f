"""The license signatures: ordered rules, each with a keyword that every text it matches contains.

Patterns are over a text's words in lower case, joined by single spaces with one before and after; a pattern is
matched between two spaces. A keyword is searched in the same text, so a space in it is the end of a word.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


#: What stands before a name where a license is granted; license in both spellings; a version in words.
U = r"(?:licen[cs]ed|relicensed|released|distributed|redistributed|available|provided|published|shared|covered|governed|offered|issued) (?:under|by) (?:the )?(?:terms of )?(?:the |an? )?"
L = r"licen[cs]e"
V = r"(?:version |ver |v ?)?"
#: The license file's own tag.
S = r"spdx license identifier "

#: Machine-readable tags: (label, keyword, pattern).
TAGS = (
    ("mit", "identifier mit ", S + r"mit"),
    ("mit-0", "identifier mit 0", S + r"mit 0"),
    ("isc", "identifier isc", S + r"isc"),
    ("0bsd", "identifier 0bsd", S + r"0bsd"),
    ("bsd-1-clause", "identifier bsd 1", S + r"bsd 1 clause"),
    ("bsd-2-clause", "identifier bsd 2", S + r"bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", "identifier bsd 3", S + r"bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4-clause", "identifier bsd 4", S + r"bsd 4 clause(?: uc)?"),
    ("apache-1.1", "identifier apache 1", S + r"apache 1 [01]"),
    ("apache-2", "identifier apache 2", S + r"apache 2 0(?: with llvm exception)?"),
    ("gpl-1", "identifier gpl 1", S + r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "identifier gpl 2", S + r"gpl 2 0(?: only| or later)?(?: with classpath exception 2 0| with linux syscall note)?"),
    ("gpl-3", "identifier gpl 3", S + r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "identifier lgpl 2 0", S + r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "identifier lgpl 2 1", S + r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "identifier lgpl 3", S + r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "identifier agpl 3", S + r"agpl 3 0(?: only| or later)?"),
    ("gfdl", "identifier gfdl", S + r"gfdl 1 [123](?: only| or later| no invariants only| no invariants or later)?"),
    ("mpl-1.1", "identifier mpl 1", S + r"mpl 1 [01]"),
    ("mpl-2", "identifier mpl 2", S + r"mpl 2 0(?: no copyleft exception)?"),
    ("epl-1", "identifier epl 1", S + r"epl 1 0"),
    ("epl-2", "identifier epl 2", S + r"epl 2 0"),
    ("cddl", "identifier cddl", S + r"cddl 1 [01]"),
    ("cpl", "identifier cpl", S + r"cpl 1 0"),
    ("ipl", "identifier ipl", S + r"ipl 1 0"),
    ("eupl", "identifier eupl", S + r"eupl 1 [012]"),
    ("osl-3", "identifier osl", S + r"osl [123] [01]"),
    ("afl-3", "identifier afl", S + r"afl [123] [012]"),
    ("artistic-1", "identifier artistic 1", S + r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2", "identifier artistic 2", S + r"artistic 2 0"),
    ("zlib", "identifier zlib", S + r"zlib(?: acknowledgement)?"),
    ("libpng", "identifier libpng", S + r"libpng(?: 2 0)?"),
    ("bsl-1", "identifier bsl 1", S + r"bsl 1 0"),
    ("busl-1.1", "identifier busl", S + r"busl 1 1"),
    ("sspl-1", "identifier sspl", S + r"sspl 1 0"),
    ("elastic-2", "identifier elastic", S + r"elastic 2 0"),
    ("unlicense", "identifier unlicense", S + r"unlicense"),
    ("wtfpl", "identifier wtfpl", S + r"wtfpl"),
    ("psf-2", "identifier psf 2", S + r"psf 2 0"),
    ("python-2", "identifier python 2", S + r"python 2 0(?: 1)?"),
    ("php-3", "identifier php 3", S + r"php 3 01?"),
    ("ruby", "identifier ruby", S + r"ruby"),
    ("postgresql", "identifier postgresql", S + r"postgresql"),
    ("openssl", "identifier openssl", S + r"openssl"),
    ("ncsa", "identifier ncsa", S + r"ncsa"),
    ("x11", "identifier x11", S + r"x11"),
    ("curl", "identifier curl", S + r"curl"),
    ("w3c", "identifier w3c", S + r"w3c"),
    ("upl-1", "identifier upl", S + r"upl 1 0"),
    ("ms-pl", "identifier ms pl", S + r"ms pl"),
    ("ms-rl", "identifier ms rl", S + r"ms rl"),
    ("ofl-1.1", "identifier ofl", S + r"ofl 1 [01]"),
    ("odbl", "identifier odbl", S + r"odbl 1 0"),
    ("odc-by", "identifier odc by", S + r"odc by 1 0"),
    ("pddl", "identifier pddl", S + r"pddl 1 0"),
    ("cc0", "identifier cc0", S + r"cc0 1 0"),
    ("cc-by", "identifier cc by ", S + r"cc by [1-4] [05]"),
    ("cc-by-sa", "identifier cc by sa", S + r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "identifier cc by nd", S + r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "identifier cc by nc ", S + r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "identifier cc by nc sa", S + r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "identifier cc by nc nd", S + r"cc by nc nd [1-4] [05]"),
    ("vim", "identifier vim", S + r"vim"),
    ("beerware", "identifier beerware", S + r"beerware"),
    ("json", "identifier json", S + r"json"),
)

#: Titles of licenses, with their versions: sure wherever they stand.
TITLES = (
    ("gpl-1", "general public", r"(?:gnu )?general public " + L + " " + V + r"1(?: 0)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public " + L + " " + V + r"2(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public " + L + " " + V + r"3(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-2", "general public", r"version 2 of the gnu general public " + L),
    ("gpl-3", "general public", r"version 3 of the gnu general public " + L),
    ("gpl-2", "either version 2", r"either version 2 of the " + L),
    ("gpl-3", "either version 3", r"either version 3 of the " + L),
    ("gpl", "general public", r"gnu general public " + L),
    ("lgpl-2", "library general", r"(?:gnu )?library general public " + L + " " + V + r"2(?: 0)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public " + L + " " + V + r"2 1"),
    ("lgpl-3", "lesser general", r"(?:gnu )?lesser general public " + L + " " + V + r"3(?: 0)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public " + L),
    ("lgpl", "library general", r"(?:gnu )?library general public " + L),
    ("agpl-3", "affero general", r"(?:gnu )?affero general public " + L + " " + V + r"3(?: 0)?"),
    ("agpl", "affero general", r"(?:gnu )?affero general public " + L),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation " + L + r"(?: " + V + r"1 [123])?"),
    ("apache-1.1", "apache software", r"apache software " + L + " " + V + r"1 [01]"),
    ("apache-2", "apache ", r"apache (?:software )?" + L + " " + V + r"2(?: 0)?"),
    ("mpl-1.1", "mozilla public", r"mozilla public " + L + " " + V + r"1 [01]"),
    ("mpl-2", "mozilla public", r"mozilla public " + L + " " + V + r"2(?: 0)?"),
    ("mpl", "mozilla public", r"mozilla public " + L),
    ("epl-1", "eclipse public", r"eclipse public " + L + " " + V + r"1(?: 0)?"),
    ("epl-2", "eclipse public", r"eclipse public " + L + " " + V + r"2(?: 0)?"),
    ("epl", "eclipse public", r"eclipse public " + L),
    ("edl-1", "eclipse distribution", r"eclipse distribution " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("cddl", "common development", r"common development and distribution " + L + r"(?: " + V + r"1(?: [01])?)?"),
    ("cpl", "common public", r"common public " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("cpal-1", "common public attribution", r"common public attribution " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("ipl", "ibm public", r"ibm public " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("eupl", "european union public", r"european union public " + L + r"(?: " + V + r"1(?: [012])?)?"),
    ("osl-3", "open software", r"open software " + L + r"(?: " + V + r"3(?: 0)?)?"),
    ("afl-3", "academic free", r"academic free " + L + r"(?: " + V + r"3(?: 0)?)?"),
    ("artistic-2", "artistic", r"artistic " + L + " " + V + r"2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic " + L + " " + V + r"1(?: 0)?"),
    ("artistic", "artistic", r"(?:perl |clarified )?artistic " + L),
    ("bsl-1", "boost software", r"boost software " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source " + L + r"(?: " + V + r"1(?: 1)?)?"),
    ("sspl-1", "server side public", r"server side public " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("elastic-2", "elastic ", r"elastic " + L + " " + V + r"2(?: 0)?"),
    ("confluent-1", "confluent community", r"confluent community " + L + r"(?: agreement)?(?: " + V + r"1(?: 0)?)?"),
    ("psf-2", "python software foundation", r"python software foundation " + L + r"(?: " + V + r"2)?"),
    ("php-3", "php ", r"php " + L + " " + V + r"3(?: 01?)?"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source " + L),
    ("upl-1", "universal permissive", r"universal permissive " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("ms-pl", "microsoft public", r"microsoft public " + L),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal " + L),
    ("ofl-1.1", "open font", r"(?:sil )?open font " + L + r"(?: " + V + r"1(?: [01])?)?"),
    ("odbl", "open database", r"(?:open data commons )?open database " + L + r"(?: odbl)?(?: " + V + r"1(?: 0)?)?"),
    ("odc-by", "open data commons attribution", r"open data commons attribution " + L),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication and " + L),
    ("cc0", "public domain dedication", r"cc0(?: 1 0)?(?: universal)? public domain dedication"),
    ("cc0", "creative commons zero", r"creative commons zero(?: " + V + r"1(?: 0)?)?"),
    ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons attribution share", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons attribution no", r"creative commons attribution no ?deriv(?:s|atives?)(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons attribution non", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons attribution non", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons attribution non", r"creative commons attribution non ?commercial no ?deriv(?:s|atives?)(?: [1-4] [05])?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)? " + L),
    ("openrail", "open rail", r"(?:creativeml |bigscience |bigcode )?open rail(?: m)? " + L),
    ("rail", "responsible ai", r"(?:bigscience )?responsible ai " + L),
    ("llama", "community license", r"llama(?: [234])?(?: [123])? community license(?: agreement)?"),
    ("gemma", "gemma terms", r"gemma terms of use"),
    ("wtfpl", "do what the", r"do what the fuck you want to public " + L),
    ("hpl", "hippocratic", r"hippocratic " + L + r"(?: " + V + r"[123](?: [01])?)?"),
    ("polyform-nc", "polyform noncommercial", r"polyform noncommercial " + L),
    ("polyform-sb", "polyform small", r"polyform small business " + L),
    ("cecill", "cecill", r"cecill(?: free software)? " + L + r"(?: agreement)?"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl) " + L + r"(?: " + V + r"[12])?"),
    ("ecl-2", "educational community", r"educational community " + L + r"(?: " + V + r"2(?: 0)?)?"),
    ("oldap-2.8", "openldap public", r"openldap public " + L + r"(?: " + V + r"2(?: 8)?)?"),
    ("nasa-1.3", "nasa open source", r"nasa open source agreement(?: " + V + r"1(?: 3)?)?"),
    ("watcom-1", "watcom public", r"sybase open watcom public " + L),
    ("apsl-2", "apple public source", r"apple public source " + L + r"(?: " + V + r"[12](?: [012])?)?"),
    ("qpl-1", "q public", r"q public " + L + r"(?: " + V + r"1(?: 0)?)?"),
    ("zpl-2.1", "zope public", r"zope public " + L + r"(?: " + V + r"[12](?: [01])?)?"),
    ("sleepycat", "sleepycat", r"sleepycat " + L),
    ("intel", "intel open source", r"intel open source " + L),
    ("lppl", "latex project public", r"latex project public " + L + r"(?: " + V + r"1(?: [0123]c?)?)?"),
    ("unicode", "unicode ", r"unicode " + L + r"(?: agreement)?(?: " + V + r"3)?"),
    ("isc", "internet systems consortium", r"internet systems consortium(?: " + L + r")?"),
    ("x11", "x consortium", r"x consortium(?: " + L + r")?"),
    ("ogl-uk-3", "open government", r"open government " + L + r"(?: " + V + r"[123](?: 0)?)?"),
)

#: Grants: a verb, "under" and the name.
GRANTS = (
    ("mit", " mit ", U + r"mit(?: x11| expat)?(?: " + L + r")?"),
    ("mit", " expat ", U + r"expat(?: mit)?(?: " + L + r")?"),
    ("mit-0", " mit no attribution", U + r"mit no attribution(?: " + L + r")?"),
    ("isc", " isc ", U + r"isc(?: " + L + r")?"),
    ("0bsd", " 0bsd ", U + r"0bsd(?: " + L + r")?"),
    ("0bsd", " zero clause bsd ", U + r"zero clause bsd(?: " + L + r")?"),
    ("bsd", " bsd ", U + r"bsd(?: style)?(?: " + L + r")?"),
    ("bsd", "berkeley software", U + r"berkeley software distribution(?: " + L + r")?"),
    ("bsd-2-clause", " bsd ", U + r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: " + L + r")?"),
    ("bsd-2-clause", " freebsd ", U + r"freebsd(?: " + L + r")?"),
    ("bsd-3-clause", " bsd ", U + r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: " + L + r")?"),
    ("bsd-4-clause", " bsd ", U + r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: " + L + r")?"),
    ("apache", " apache ", U + r"apache(?: software)?(?: foundation)?(?: " + L + r")?"),
    ("apache-2", " apache ", U + r"apache " + V + r"2(?: 0)?"),
    ("apache-2", " asl ", U + r"asl " + V + r"2(?: 0)?"),
    ("gpl", " gpl ", U + r"(?:gnu )?gpl(?: " + L + r")?"),
    ("gpl-2", " gpl", U + r"(?:gnu )?(?:gpl " + V + r"2(?: 0)?|gplv2)(?: or later)?"),
    ("gpl-3", " gpl", U + r"(?:gnu )?(?:gpl " + V + r"3(?: 0)?|gplv3)(?: or later)?"),
    ("lgpl", " lgpl ", U + r"(?:gnu )?lgpl(?: " + L + r")?"),
    ("lgpl-2.1", " lgpl", U + r"(?:gnu )?(?:lgpl " + V + r"2 1|lgplv2 1)(?: or later)?"),
    ("lgpl-3", " lgpl", U + r"(?:gnu )?(?:lgpl " + V + r"3(?: 0)?|lgplv3)(?: or later)?"),
    ("agpl", " agpl ", U + r"(?:gnu )?agpl(?: " + L + r")?"),
    ("agpl-3", " agpl", U + r"(?:gnu )?(?:agpl " + V + r"3(?: 0)?|agplv3)(?: or later)?"),
    ("gfdl", " gfdl ", U + r"(?:gnu )?gfdl(?: " + V + r"1 [123])?"),
    ("mpl", " mpl ", U + r"mpl(?: " + L + r")?"),
    ("mpl-1.1", " mpl ", U + r"mpl " + V + r"1 1"),
    ("mpl-2", " mpl ", U + r"mpl " + V + r"2(?: 0)?"),
    ("epl", " epl ", U + r"epl(?: " + L + r")?"),
    ("epl-1", " epl ", U + r"epl " + V + r"1(?: 0)?"),
    ("epl-2", " epl ", U + r"epl " + V + r"2(?: 0)?"),
    ("cddl", " cddl ", U + r"cddl(?: " + V + r"1(?: [01])?)?"),
    ("cpl", " cpl ", U + r"cpl(?: " + V + r"1(?: 0)?)?"),
    ("eupl", " eupl ", U + r"eupl(?: " + V + r"1(?: [012])?)?"),
    ("osl-3", " osl ", U + r"osl(?: " + V + r"3(?: 0)?)?"),
    ("afl-3", " afl ", U + r"afl(?: " + V + r"3(?: 0)?)?"),
    ("artistic", " artistic ", U + r"artistic"),
    ("zlib", " zlib ", U + r"zlib(?: libpng)?(?: " + L + r")?"),
    ("libpng", " libpng ", U + r"libpng(?: " + L + r")?"),
    ("bsl-1", " boost ", U + r"boost(?: " + L + r")?"),
    ("bsl-1", " bsl ", U + r"bsl 1 0"),
    ("busl-1.1", " busl", U + r"busl(?: 1 1)?"),
    ("sspl-1", " sspl", U + r"sspl(?: " + V + r"1)?"),
    ("elastic", " elastic ", U + r"elastic(?: " + L + r")?"),
    ("unlicense", " unlicense", U + r"unlicense"),
    ("wtfpl", " wtfpl", U + r"wtfpl"),
    ("psf-2", " psf ", U + r"psf(?: " + L + r")?"),
    ("python-2", " python ", U + r"python " + L),
    ("php-3", " php ", U + r"php(?: " + L + r")?"),
    ("ruby", " ruby ", U + r"ruby(?: " + L + r"| s " + L + r")?"),
    ("perl", " perl ", U + r"same terms as perl(?: itself)?"),
    ("postgresql", " postgresql ", U + r"postgresql(?: " + L + r")?"),
    ("openssl", " openssl ", U + r"openssl(?: " + L + r")?"),
    ("ncsa", " ncsa ", U + r"(?:university of illinois )?ncsa(?: " + L + r")?"),
    ("x11", " x11 ", U + r"x11(?: " + L + r")?"),
    ("curl", " curl ", U + r"curl " + L),
    ("w3c", " w3c ", U + r"w3c(?: software)?(?: " + L + r")?"),
    ("upl-1", " upl ", U + r"upl(?: 1 0)?"),
    ("ms-pl", " ms pl ", U + r"ms pl"),
    ("ms-rl", " ms rl ", U + r"ms rl"),
    ("ofl-1.1", " ofl ", U + r"(?:sil )?ofl(?: " + V + r"1 [01])?"),
    ("odbl", " odbl ", U + r"odbl(?: " + V + r"1(?: 0)?)?"),
    ("odc-by", " odc by ", U + r"odc by(?: " + V + r"1(?: 0)?)?"),
    ("pddl", " pddl ", U + r"pddl(?: " + V + r"1(?: 0)?)?"),
    ("cc0", " cc0 ", U + r"cc0(?: " + V + r"1(?: 0)?)?"),
    ("cc0", " cc zero ", U + r"cc zero"),
    ("openrail", "openrail", U + r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?"),
    ("creative-commons", " creative commons ", U + r"creative commons(?: " + L + r")?"),
    ("vim", " vim ", U + r"vim " + L),
    ("json", " json ", U + r"json " + L),
    ("tcl", " tcl ", U + r"tcl(?: tk)? " + L),
    ("dual-gpl-mit", " dual ", r"dual licen[cs]ed under (?:the )?(?:mit and gpl|gpl and mit|mit or gpl|gpl or mit)"),
)

#: Short names before or after the word license, and names that stand alone.
NAMES = (
    ("mit", " mit ", r"(?:the )?mit(?: x11| expat)? (?:open source )?" + L),
    ("mit", " mit ", L + r"(?: is| type)? mit"),
    ("mit", " expat ", r"(?:the )?expat " + L),
    ("isc", " isc ", r"(?:the )?isc " + L),
    ("0bsd", " 0bsd ", r"(?:the )?0bsd " + L),
    ("bsd", " bsd ", r"(?:the )?bsd(?: style)? " + L),
    ("bsd", " bsd ", L + r"(?: is| type)? bsd"),
    ("bsd-2-clause", " freebsd ", r"(?:the )?freebsd " + L),
    ("bsd-2-clause", " bsd ", r"bsd 2 clause(?: " + L + r")?|(?:2 clause|two clause|simplified) bsd(?: " + L + r")?"),
    ("bsd-3-clause", " bsd ", r"bsd 3 clause(?: " + L + r")?|(?:3 clause|three clause|new|modified|revised) bsd(?: " + L + r")?"),
    ("bsd-4-clause", " bsd ", r"bsd 4 clause(?: " + L + r")?|(?:4 clause|four clause|original) bsd(?: " + L + r")?"),
    ("0bsd", " bsd ", r"(?:zero clause bsd|bsd zero clause)(?: " + L + r")?"),
    ("apache", " apache ", r"(?:the )?apache(?: software)? " + L),
    ("apache", " apache ", L + r"(?: is| type)? apache"),
    ("apache-2", " apache ", r"apache 2 0(?: " + L + r")?"),
    ("gpl", " gpl ", r"(?:the )?(?:gnu )?gpl(?: " + L + r")?"),
    ("gpl-2", " gpl", r"(?:gnu )?(?:gpl " + V + r"2(?: 0)?|gplv2)(?: or later)?"),
    ("gpl-3", " gpl", r"(?:gnu )?(?:gpl " + V + r"3(?: 0)?|gplv3)(?: or later)?"),
    ("lgpl", " lgpl ", r"(?:the )?(?:gnu )?lgpl(?: " + L + r")?"),
    ("lgpl-2.1", " lgpl", r"(?:gnu )?(?:lgpl " + V + r"2 1|lgplv2 1)(?: or later)?"),
    ("lgpl-3", " lgpl", r"(?:gnu )?(?:lgpl " + V + r"3(?: 0)?|lgplv3)(?: or later)?"),
    ("agpl", " agpl ", r"(?:the )?(?:gnu )?agpl(?: " + L + r")?"),
    ("agpl-3", " agpl", r"(?:gnu )?(?:agpl " + V + r"3(?: 0)?|agplv3)(?: or later)?"),
    ("gfdl", " gfdl ", r"(?:the )?(?:gnu )?gfdl"),
    ("mpl", " mpl ", r"(?:the )?mpl " + L),
    ("mpl-2", " mpl ", r"mpl " + V + r"2 0"),
    ("epl", " epl ", r"(?:the )?epl " + L),
    ("epl-2", " epl ", r"epl " + V + r"2 0"),
    ("cddl", " cddl ", r"(?:the )?cddl(?: " + L + r")?"),
    ("eupl", " eupl ", r"(?:the )?eupl(?: " + L + r")?"),
    ("zlib", " zlib ", r"(?:the )?zlib(?: libpng)? " + L),
    ("libpng", " libpng ", r"(?:the )?libpng " + L),
    ("unlicense", " unlicense ", r"(?:the )?unlicense"),
    ("wtfpl", " wtfpl ", r"wtfpl"),
    ("psf-2", " psf ", r"(?:the )?psf " + L),
    ("python-2", " python ", r"(?:the )?python " + L),
    ("php-3", " php ", r"(?:the )?php " + L),
    ("ruby", " ruby ", r"(?:the )?ruby(?: s)? " + L),
    ("postgresql", " postgresql ", r"(?:the )?postgresql " + L),
    ("openssl", " openssl ", r"(?:the )?openssl " + L),
    ("ncsa", " ncsa ", r"(?:the )?ncsa(?: open source)? " + L),
    ("x11", " x11 ", r"(?:the )?x11 " + L),
    ("curl", " curl ", r"(?:the )?curl " + L),
    ("w3c", " w3c ", r"(?:the )?w3c(?: software)?(?: notice and)? " + L),
    ("ofl-1.1", " ofl ", r"(?:sil )?ofl 1 [01]|(?:the )?(?:sil )?ofl " + L),
    ("odbl", " odbl ", r"odbl"),
    ("pddl", " pddl ", r"pddl"),
    ("cc0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", " cc zero ", r"cc zero"),
    ("cc-by", " cc by ", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", " cc by sa ", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", " cc by nd ", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", " cc by nc ", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", " cc by nc sa ", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", " cc by nc nd ", r"cc by nc nd(?: [1-4] [05])?"),
    ("creative-commons", " creative commons ", r"(?:the |a )?creative commons " + L),
    ("vim", " vim ", r"(?:the )?vim " + L),
    ("beerware", " beer", r"(?:the )?beer ?ware " + L),
    ("json", " json ", r"(?:the )?json " + L),
    ("elastic", " elastic ", r"(?:the )?elastic " + L),
    ("fair-source", " fair source ", r"fair source " + L),
    ("mit", " mit or ", r"mit or"),
    ("mit", " mit licensed ", r"mit licensed"),
    ("mit", " mit licenced ", r"mit licenced"),
    ("apache-2", " apache licensed ", r"apache licensed"),
    ("bsd", " bsd licensed ", r"bsd licensed"),
    ("gpl", " gpl licensed ", r"gpl licensed"),
)

#: Sentences of license texts and notices.
NOTICES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of", r"neither the name of (?:the copyright holder|the author|the university|the organization) nor the names of its contributors"),
    ("json", "for good not evil", r"the software shall be used for good not evil"),
    ("zlib", "this software is provided as is", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("gpl", "free software you can redistribute", r"(?:this (?:program|library|file) is )?free software you can redistribute it(?: and or modify it)?"),
    ("cc0", "waived all copyright", r"has waived all copyright and related(?: or neighboring)? rights"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:into|in|to) the public domain"),
    ("public-domain", "public domain", r"public domain(?: mark)?(?: 1 0)?"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "proprietary", r"proprietary(?: software)? " + L + r"(?: agreement)?"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("non-commercial", "non commercial use only", r"(?:for )?non commercial use only"),
    ("research-only", "research purposes only", r"(?:for )?(?:academic )?research purposes only"),
    ("no-redistribution", "may not be redistributed", r"may not be redistributed without(?: prior)?(?: written)? permission"),
    ("eula", "end user license", r"end user license agreement"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
)

#: (rules, priority, score) from the strongest on.
TIERS = ((TAGS, 0, 1.0), (TITLES, 1, 0.95), (GRANTS, 2, 0.9), (NAMES, 3, 0.8), (NOTICES, 4, 0.7))


def signatures() -> list[Signature]:
    """All rules in order."""
    return [Signature(label, keyword, rf"(?<= )(?:{pattern})(?= )", priority, score) for rules, priority, score in TIERS for label, keyword, pattern in rules]
