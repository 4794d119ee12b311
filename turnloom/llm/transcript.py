"""Reading one transcript: lines, stamps, speaker labels, sound notes and hesitation."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

# Names of the two roles in several languages, and words for a speaker without a role.
THERAPIST_WORDS = """
therapist therapistin t th counsellor counselor clinician psychologist interviewer practitioner psychotherapist coach
terapeuta psicóloga psicólogo thérapeute psychologue therapeut therapeutin berater beraterin psychologin चिकित्सक परामर्शदाता काउंसलर थेरेपिस्ट சிகிச்சையாளர் ஆலோசகர்
""".split()  # fmt: skip
CLIENT_WORDS = """
client c cl patient pt participant helpseeker interviewee cliente paciente patiente klient klientin patientin ग्राहक क्लाइंट रोगी मरीज வாடிக்கையாளர் நோயாளி
""".split()  # fmt: skip
SPEAKER_WORDS = "speaker spk s voice person hablante falante locuteur sprecher sprecherin वक्ता பேச்சாளர்".split()
# Sounds of hesitation in the languages of the transcripts.
HESITATION_WORDS = "um umm uh uhh uhm er err erm hm hmm mm mmm mhm mhmm ah eh em este euh heu äh ähm öh hum ééé éé ahn tipo उम्म उम्म् हम्म अं அ ம்ம் ம்ம்ம் ஹ்ம்".split()

LINE_END = re.compile(r"\r?\n")
_CLOCK = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
CUE_TIMES = re.compile(rf"^\s*({_CLOCK})\s*-->\s*({_CLOCK}).*$")
_STAMP = re.compile(rf"^\s*(?:\[\s*({_CLOCK})\s*\]|\(\s*({_CLOCK})\s*\)|({_CLOCK})(?!\d|\]|\)|[.,:]\d)(?:\s*[-–]\s(?=\S))?)\s*")
_FRAMED = re.compile(r"^\s*([-–—=~_*#]{2,})[^\n]*?[-–—=~_*#]{2,}\s*$")
_BULLET = re.compile(r"^\s*[-–•]\s+(?=\S)")
_VOICE = re.compile(r"^\s*<v(?:\.[\w.]+)?\s+([^>]{1,40})>\s*")
_BRACKET = re.compile(r"^\s*\[([^\]\n]{1,30})\]\s*(?:[:：]|[-–]\s)?\s*")
_PLAIN = re.compile(r"^\s*([^\s:：\t][^:：\t\n]{0,29}?)\s*(?:[:：]|\t|\s[-–—](?:\s|$))\s*")
_NOTES = re.compile(r"\(\([^()\n]*\)\)?|\[[^\[\]]*\]|\{[^{}]*\}|\([^()]*\)|\*(?=\S)[^*\n]*\*|<(?=\S)[^<>@]*>|[♪♫♬]")
_NOTE_SIGNS = "([{*<♪♫♬"
_CLOCKS = re.compile(rf"(?<!\d){_CLOCK}(?!\d)")
_WORDS = re.compile(r"[^\W_]+(?:[ऀ-෿̀-ͯ]+[^\W_]*)*")
_HESITATION = re.compile(
    r"(?<![\w'’-])(?:" + "|".join(sorted(map(re.escape, set(HESITATION_WORDS) - {"este", "tipo", "em", "hum"}), key=len, reverse=True)) + r")(?![\w'’-])(?:\s*-(?=\s))?[,.…]*",
    re.IGNORECASE,
)
_LOOSE_HESITATION = re.compile(r"(?<![\w'’-])(?:este|tipo|em|hum|you know),(?=\s)", re.IGNORECASE)
_HESITATION_SET = frozenset(HESITATION_WORDS)
_BETWEEN = ",.…?!;:\"“”()[]—–/*"


def _edits(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


@lru_cache(maxsize=100_000)
def label_of(stored: str) -> tuple[str, str | None] | None:
    """``(key, role)`` of a speaker label: role is 'therapist', 'client', or None for a speaker without a role; None if it names no speaker.

    Case, brackets, full stops, separators and trailing numbers make no difference to a role; one slip of the pen (a letter left out, added,
    changed or swapped with its neighbour) in a role of five or more letters is forgiven.
    """
    plain = unicodedata.normalize("NFKC", stored).strip().strip("[]<>(){}").casefold()
    plain = re.sub(r"[.:：\s]+$", "", plain).strip()
    parts = re.fullmatch(r"(.*?)[\s_.#-]*(\d{1,3}|(?<=[\s_])[a-z])?", plain)
    word, mark = re.sub(r"[\s_.\-]", "", parts[1]), parts[2] or ""
    if word in THERAPIST_WORDS:
        return "therapist", "therapist"
    if word in CLIENT_WORDS:
        return "client", "client"
    if word in SPEAKER_WORDS and mark:
        return word + mark, None
    if len(word) >= 5 and word.isalpha():
        for words, role in ((THERAPIST_WORDS, "therapist"), (CLIENT_WORDS, "client")):
            if any(len(w) >= 5 and abs(len(w) - len(word)) <= 1 and _edits(w, word) == 1 for w in words):
                return role, role
    return None


def _seconds(clock: str) -> float:
    total = 0.0
    for part in clock.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def strip_stamps(line: str) -> tuple[str, float | None]:
    """The line without the stamps and the list dash in front, and the first stamp in seconds."""
    at, first = None, line.lstrip()[:1]
    if not first.isdecimal() and first not in "[(-–•":
        return line, at
    while True:
        m = _STAMP.match(line)
        if m and (m[1] or m[2] or line[m.end() - 1 : m.end()].isspace() or m.end() == len(line)):
            at = _seconds(m[1] or m[2] or m[3]) if at is None else at
            line = line[m.end() :]
            continue
        m = _BULLET.match(line)
        if not m:
            return line, at
        line = line[m.end() :]


def split_label(line: str, extra: frozenset[str] = frozenset()) -> tuple[str, str | None, str] | None:
    """``(key, role, rest)`` where the line starts with a speaker label; ``extra`` holds further labels as they are spelled."""
    for pattern in (_VOICE, _BRACKET, _PLAIN):
        m = pattern.match(line)
        if not m:
            continue
        found = label_of(m[1])
        if found is None and (m[1] in extra or pattern is _VOICE):
            found = (m[1].strip().casefold(), None)
        if found:
            return found[0], found[1], line[m.end() :]
    return None


def without_notes(text: str) -> str:
    """Text without sound notes, stamps in brackets and music signs."""
    if any(c in text for c in _NOTE_SIGNS):
        text = _NOTES.sub(" ", text)
    return " ".join(text.split())


def without_hesitation(text: str) -> str:
    plain = text.casefold()
    for c in _BETWEEN:
        plain = plain.replace(c, " ")
    if not _HESITATION_SET.isdisjoint(plain.split()):
        text = _HESITATION.sub(" ", text)
        text = _LOOSE_HESITATION.sub(" ", text)
    elif "," in text and "know," in text.casefold():
        text = _LOOSE_HESITATION.sub(" ", text)
    return " ".join(text.split())


def words_said(text: str) -> bool:
    """Whether a word is left of a text without notes once stamps, cue numbers and hesitation are gone."""
    numbers = False
    for m in _WORDS.finditer(text):
        word = m.group()
        if word[0].isdecimal():
            numbers = True
        elif word.casefold() not in _HESITATION_SET:
            return True
    return numbers and any(w.casefold() not in _HESITATION_SET for w in _WORDS.findall(_CLOCKS.sub(" ", text)))


def says_something(text: str) -> bool:
    """Whether a word is left once notes, stamps, cue numbers and hesitation are gone."""
    return words_said(without_notes(text))


@dataclass
class Entry:
    line_no: int
    key: str
    role: str | None
    start: float | None
    parts: list[str] = field(default_factory=list)
    end: float | None = None

    @property
    def text(self) -> str:
        return " ".join(self.parts)


def _own_labels(lines: list[str]) -> frozenset[str]:
    """Labels of a transcript that uses names: the same short words before a colon on three or more lines, by two or more speakers."""
    seen: dict[str, int] = {}
    for line in lines:
        m = re.match(r"([^\W\d_][^\s:：]{0,20}(?: [^\s:：]{1,20})?)\s*[:：]\s", strip_stamps(line)[0])
        if m:
            seen[m[1]] = seen.get(m[1], 0) + 1
    often = frozenset(k for k, n in seen.items() if n >= 3)
    return often if len(often) >= 2 else frozenset()


def parse(text: str) -> tuple[list[Entry], list[str]]:
    """``(entries, header)``: labelled lines with the lines up to the next label; lines before the first label are the header."""
    lines = LINE_END.split(text)
    entries, header = _entries(lines, frozenset())
    if not entries and (own := _own_labels(lines)):
        entries, header = _entries(lines, own)
    return entries, header


def _entries(lines: list[str], extra: frozenset[str]) -> tuple[list[Entry], list[str]]:
    entries: list[Entry] = []
    header: list[str] = []
    cue_start = cue_end = None
    for no, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.isdecimal() and len(bare) <= 6 or bare[0] in "-–—=~_*#" and _FRAMED.match(line):
            continue
        if "-->" in line and (m := CUE_TIMES.match(line)):
            cue_start, cue_end = _seconds(m[1]), _seconds(m[2])
            continue
        bare, at = strip_stamps(line)
        if found := split_label(bare, extra):
            entries.append(Entry(no, found[0], found[1], cue_start if at is None else at, [found[2]], cue_end if at is None else None))
            cue_start = cue_end = None
        elif entries:
            entries[-1].end = entries[-1].end if cue_end is None else cue_end
            entries[-1].parts.append(bare if at is not None else line.strip())
        else:
            header.append(bare)
    return entries, header
