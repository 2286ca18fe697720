"""Problem 3: sentence boundaries across languages and scripts.

Method. A text is cut at blank lines into blocks. In a block every place where a sentence could end becomes a node of a
lattice, from the block's start to its end; an arc between neighbouring nodes is a stretch that is not divided, and a node
is kept as a boundary or passed over by what stands on its two sides.

* Spaced scripts: nodes stand after runs of terminators and the closing marks that follow. Quotations and brackets are
  paired first, and nodes inside a pair are removed. Abbreviations, ordinals, initials, list numbers and a following
  lower-case word make a node no boundary; a lower-case word with digits or underscores is a name and may open a sentence.
* Spaceless scripts: runs of letters are cut into words by the cheapest path through a dictionary lattice. Where a script
  has terminators (Chinese, Japanese), a node after them is a boundary unless the next word is a particle that continues
  the sentence after a quotation. Where it has none (Thai, Lao), every gap is a node, and it is a boundary if the
  word before it is a closing particle and the word after it does not carry on, or if the word before it does not carry on and
  the word after it opens a sentence.

Defined cases: null and blank texts have no units; white space of any kind around a unit is not part of it; offsets are
code points of the text as stored; repeated rows give the same units; a text is never shortened.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\x85  ])[^\S\n\r\x85  ]*(?:\r\n|[\n\r\x85  ])\s*")
END = re.compile(r"[.!?…‥‼-‽⁇-⁉。．！？｡।॥؟۔።፧។៕၊။]+")
HARD = set("。！？｡．។៕။။")
PAIRS = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "［": "］", "〈": "〉", "《": "》", "«": "»", "‹": "›", "„": "“", "“": "”", "‚": "‘"}
CLOSERS = set(PAIRS.values()) | {'"', "'", "’"}
OPENED_BY = {c: "".join(o for o in PAIRS if PAIRS[o] == c) for c in PAIRS.values()}
MARKS = set(PAIRS) | CLOSERS | {"‘"}

#: Abbreviations after which a sentence goes on whatever follows. Lower case, without the last period, blanks dropped.
ALWAYS = set(
    "fig figs sec secs ch chap eq no nos nr vs approx max min cf e.g i.e viz rev ver vol pp art pos st mr mrs ms dr prof sr jr dept mt "
    "z.b d.h u.a abschn abb bzw ca evtl ggf inkl zzgl vgl tel hr fr "
    "p.ej pág págs aprox depto núm dpto ej sra "
    "p.ex env réf éd mme mlle al "
    "т.е т.д рис см п стр гл табл напр".split()
)
#: Abbreviations that may also end a sentence: they do before a capital.
SOMETIMES = set("inc corp ltd co llc gmbh etc incl u.s u.k u.s.a e.u a.m p.m a.k.a s sec hrs hr mins ft lb н.э г гг в вв э usw u.s.w".split())
#: These are abbreviations only before a digit.
BEFORE_DIGIT = set("no nos sec fig art max min pos st п al fr hr см ch v p pp n r стр".split())
#: German month names after an ordinal, and other nouns that take one.
ORDINAL_NOUNS = set("januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert".split())

#: Thai words for the lattice: connectives, particles, and words of the domain. Openers and closers are marked below.
THAI = (
    "โปรด กรุณา คะแนน ความรุนแรง คือ จาก สิบ เต็ม ปรับปรุง โดย เร็ว ที่สุด บันทึก ระบบ แสดง รหัส ก่อน หยุด ทำงาน ฟังก์ชัน ไม่ ตรวจสอบ ความยาว "
    "ของ ข้อมูล ผู้โจมตี ผู้ใช้ ผู้ดูแล ส่ง ไป ยัง พอร์ต เพื่อ บริการ พบ ช่องโหว่ ใน ซึ่ง ทำให้ อ่าน หน่วยความจำ ได้ แนวทาง แก้ไข ผลกระทบ ที่ และ หรือ "
    "แต่ กับ แล้ว ครับ ค่ะ คะ นะ ไหม มั้ย หรือไม่ เลย ด้วย กัน อยู่ มา ขึ้น ลง ไว้ เท่านั้น เช่นกัน หาก ถ้า เมื่อ หลังจาก ขณะ ดังนั้น อย่างไรก็ตาม "
    "นอกจากนี้ เนื่องจาก เพราะ สำหรับ การ ความ มี เป็น ถูก ให้ จะ ต้อง ควร สามารถ อาจ ยัง จึง ก็ นี้ นั้น เขา เรา ท่าน บริษัท ผู้ผลิต รุ่น เวอร์ชัน "
    "ปัญหา ไฟล์ คำสั่ง เครื่อง เครือข่าย รหัสผ่าน อัปเดต ติดตั้ง ปิด เปิด ใช้ งาน ทันที รายงาน ระบุ ว่า พบว่า ตรวจพบ ทั้งหมด ทุก บาง หลาย ตาม แบบ เช่น".split()
)
THAI_OPENS = set(
    "โปรด กรุณา คะแนน บันทึก ฟังก์ชัน ผู้โจมตี ผู้ใช้ ผู้ดูแล ผู้ผลิต พบ ตรวจพบ พบว่า หาก ถ้า เมื่อ หลังจาก ขณะ ดังนั้น อย่างไรก็ตาม นอกจากนี้ เนื่องจาก "
    "สำหรับ การ ความ ระบบ บริษัท ช่องโหว่ ปัญหา รุ่น ไฟล์ เขา เรา ท่าน รายงาน ปิด เปิด ติดตั้ง อัปเดต เครื่อง แนวทาง ผลกระทบ".split()
)
#: Words of everyday Thai that open a sentence: who (pronouns, relatives, persons), when, and how it follows from the last one.
THAI_OPENS |= set(
    "ฉัน ดิฉัน ผม กระผม ข้าพเจ้า คุณ เธอ มัน พวกเขา พวกเรา หล่อน ใคร ทุกคน บางคน หลายคน พ่อ แม่ พี่ น้อง ลูก ปู่ ย่า ตา ยาย ลุง ป้า น้า อา เพื่อน ครู หมอ เด็ก คน แมว หมา "
    "วันนี้ พรุ่งนี้ เมื่อวาน เมื่อวานนี้ เมื่อคืน คืนนี้ ตอนนี้ ตอนแรก ขณะนี้ ปัจจุบัน ต่อมา ต่อจากนั้น จากนั้น หลังจากนั้น ก่อนหน้านี้ ในที่สุด ปีนี้ ปีที่แล้ว เดือนนี้ สัปดาห์นี้ เช้านี้ เย็นนี้ วันหนึ่ง "
    "เพราะฉะนั้น เพราะเหตุนี้ ด้วยเหตุนี้ แต่ทว่า ถึงแม้ แม้ว่า ทั้งนี้ อนึ่ง ประการแรก ตัวอย่างเช่น กล่าวคือ สรุปแล้ว แน่นอน บางที อาจจะ ทำไม อะไร ที่ไหน เมื่อไร อย่างไร ห้าม อย่า ขอ เชิญ".split()
)
#: Particles that close a sentence whatever follows, but a word that carries it on.
THAI_CLOSES = set("ครับ ครับผม คับ ค่ะ คะ นะ นะคะ นะครับ จ้ะ จ๊ะ จ้า ไหม มั้ย หรือไม่ หรือเปล่า เถอะ เถิด สิ ซิ ล่ะ".split())
LAO_CLOSES = set("ເດີ ແດ່ ບໍ ບໍ່ ເນາະ ນໍ ຫວາ".split())
#: Words after a closing particle that carry the sentence on all the same.
STILL_GOES_ON = set("ก็ จึง ด้วย แล้ว ກໍ ຈຶ່ງ ດ້ວຍ ແລ້ວ".split())
LAO_OPENS = set("ກະລຸນາ ຖ້າ ຫາກ ເມື່ອ ຫຼັງຈາກ ດັ່ງນັ້ນ ແນວໃດກໍຕາມ ນອກຈາກນີ້ ເນື່ອງຈາກ ສໍາລັບ ສຳລັບ ລະບົບ ຜູ້ໃຊ້ ຜູ້ໂຈມຕີ ຜູ້ດູແລ ບໍລິສັດ ບັນຫາ ການ ຄວາມ ພົບ ເຮົາ ພວກເຮົາ ເຂົາ ລາຍງານ ໄຟລ໌ ຊ່ອງໂຫວ່".split())
#: Words of everyday Lao that open a sentence.
LAO_OPENS |= set("ຂ້ອຍ ຂ້າພະເຈົ້າ ເຈົ້າ ລາວ ມັນ ພວກເຂົາ ທ່ານ ໃຜ ທຸກຄົນ ພໍ່ ແມ່ ອ້າຍ ເອື້ອຍ ນ້ອງ ລູກ ປູ່ ຍ່າ ລຸງ ປ້າ ໝູ່ ຄູ ທ່ານໝໍ ເດັກນ້ອຍ ຄົນ ແມວ ໝາ ມື້ນີ້ ມື້ອື່ນ ມື້ວານ ມື້ວານນີ້ ຄືນນີ້ ຕອນນີ້ ປັດຈຸບັນ ຕໍ່ມາ ຈາກນັ້ນ ຫຼັງຈາກນັ້ນ ໃນທີ່ສຸດ ປີນີ້ ເດືອນນີ້ ອາທິດນີ້ ເພາະສະນັ້ນ ເຖິງແມ່ນວ່າ ເປັນຫຍັງ ຫ້າມ ຢ່າ ຂໍ ເຊີນ".split())
LAO_GOES_ON = set("ຄື ໃນ ຂອງ ທີ່ ຊຶ່ງ ແລະ ຫຼື ແຕ່ ກັບ ຈາກ ຍັງ ໄປ ເພື່ອ ໂດຍ ກ່ອນ ວ່າ ເປັນ ໃຫ້ ຈະ ຕ້ອງ ຄວນ ຖືກ ຕາມ ແບບ ເຊັ່ນ ສໍາລັບ ສຳລັບ ການ ຄວາມ ທຸກ ບາງ ຫຼາຍ".split())
LAO = "ສົ່ງ ຂໍ້ມູນ ບໍລິການ ອ່ານ ໄດ້ ແກ້ໄຂ ມີ ນີ້ ນັ້ນ ຢູ່ ມາ ຂຶ້ນ ລົງ ໄວ້ ກວດສອບ ປັບປຸງ ຕິດຕັ້ງ ເປີດ ປິດ ໃຊ້ ງານ ທັນທີ ລຸ້ນ ເຄື່ອງ ເຄືອຂ່າຍ ລະຫັດຜ່ານ ຄຳສັ່ງ ຂອບໃຈ".split()
THAI_GOES_ON = set("คือ ใน ของ ที่ ซึ่ง และ หรือ แต่ กับ จาก ยัง ไป เพื่อ โดย ก่อน ว่า เป็น ให้ จะ ต้อง ควร ไม่ ถูก ตาม แบบ เช่น ระบุ พอร์ต รหัส ฟังก์ชัน ปรับปรุง สำหรับ การ ความ เวอร์ชัน รุ่น ทุก บาง หลาย".split())
#: Japanese and Chinese words that carry a sentence on after a quotation.
JAPANESE = ["と", "という", "として", "との", "とは", "って", "など", "は", "が", "を", "に", "で", "も", "や", "の", "から", "まで", "その", "それ", "この", "これ", "ところ", "とき", "ともに", "のみ", "もし", "では", "でも", "なお", "また", "やがて", "がんばる"]
JAPANESE_GOES_ON = {"と", "という", "として", "との", "とは", "って", "など", "は", "が", "を", "に", "で", "も", "や", "の", "から", "まで"}
CHINESE = ["的", "等", "和", "与", "及", "是", "的话", "等等", "是否", "和平", "与此", "及时", "然后", "随后", "此外", "但是", "因此"]
CHINESE_GOES_ON = {"的", "等", "和", "与", "及", "是", "的话", "等等"}
#: Words of caseless spaced scripts that carry a sentence on after a quotation.
CASELESS_GOES_ON = {"और", "तथा", "एवं", "लेकिन", "किंतु", "परंतु", "पर", "कि", "को", "ने", "के", "का", "की", "से", "में", "कहा", "لكن", "حسب", "وفق", "كما", "بحسب"}


class Words:
    """The dictionary of a script, and which of its words open, close or carry on a sentence."""

    def __init__(self, known: set[str], opens: set[str], closes: set[str], goes_on: set[str]):
        self.known, self.opens, self.closes, self.goes_on = known | opens | closes | goes_on, opens, closes, goes_on
        self.longest = max(map(len, self.known))

    def with_openers(self, found: set[str]) -> Words:
        return Words(self.known, self.opens | (found - self.goes_on - self.closes), self.closes, self.goes_on)


def lattice_words(run: str, words: set[str], longest: int) -> list[str]:
    """The cheapest cut of a run of letters: a dictionary word costs 1, a character outside of any word 1.5."""
    n = len(run)
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        here = cost[i]
        if here + 1.5 < cost[i + 1]:
            cost[i + 1], back[i + 1] = here + 1.5, i
        for j in range(i + 1, min(n, i + longest) + 1):
            if here + 1 < cost[j] and run[i:j] in words:
                cost[j], back[j] = here + 1, i
    out, j = [], n
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


LEXICA = {"thai": Words(set(THAI) | STILL_GOES_ON, THAI_OPENS, THAI_CLOSES, THAI_GOES_ON), "lao": Words(set(LAO) | STILL_GOES_ON, LAO_OPENS, LAO_CLOSES, LAO_GOES_ON)}
_LEX = {"ja": set(JAPANESE), "zh": set(CHINESE)}
_LONGEST = {k: max(map(len, v)) for k, v in _LEX.items()}
THAI_RUN = re.compile(r"[฀-໿]+")
KANA = re.compile(r"[぀-ヿ]")
HAN = re.compile(r"[㐀-鿿豈-﫿]")
SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
SPACELESS_RUN = re.compile(f"(?:{SPACELESS.pattern})+")
TOKEN = re.compile(r"[^\s]+")
BARE = re.compile(r"[^\s.,!?;:।؟،]+")
INITIAL = re.compile(r"\w\.(?!\w)")


def _pairs(t: str, b: int, e: int) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets in a block; marks without a partner are ignored."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    held_of: Counter[str] = Counter()  # open marks by kind, so that a mark without a partner costs nothing

    def close(kinds: str, i: int) -> None:
        """Pair the last open mark of these kinds with i; marks opened since then have no partner."""
        while True:
            mark, at = stack.pop()
            held_of[mark] -= 1
            if mark in kinds:
                found.append((at, i))
                return

    def push(mark: str, i: int) -> None:
        stack.append((mark, i))
        held_of[mark] += 1

    for i in range(b, e):
        ch = t[i]
        if ch not in MARKS:
            continue
        if ch == "'" or ch == "’":
            after = t[i + 1] if i + 1 < e else " "
            if ch == "'" and (i == b or t[i - 1].isspace() or t[i - 1] in PAIRS) and not after.isspace():
                push("'", i)
            elif not after.isalnum() and held_of["'"] + held_of["‘"]:
                close("'‘", i)
        elif ch == '"':
            before, after = t[i - 1] if i > b else " ", t[i + 1] if i + 1 < e else " "
            if held_of['"'] and not ((before.isspace() or before in PAIRS) and not after.isspace()):
                close('"', i)
            elif not (before.isdigit() and not after.isalnum()):  # else it stands for inches
                push('"', i)  # one that was open has no partner
        elif ch in OPENED_BY and any(held_of[o] for o in OPENED_BY[ch]):
            close(OPENED_BY[ch], i)
        elif ch in PAIRS or ch == "‘":
            push(ch, i)
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, c in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


def _abbreviation(t: str, b: int, dot: int) -> str:
    """The abbreviation that ends at the period ``dot``: letters and periods, with single letters before it joined (``z. B``)."""
    i = dot
    while i > b and (t[i - 1].isalpha() or (t[i - 1] == "." and i - 1 > b and t[i - 2].isalpha())):
        i -= 1
    word = t[i:dot]
    while True:  # single letters before: "т. е", "до н. э", "p. ej"
        j = i
        while j > b and t[j - 1].isspace():
            j -= 1
        single = j < i and j - b >= 2 and t[j - 1] == "." and t[j - 2].isalpha()
        if not single or (j - b > 2 and not (t[j - 3].isspace() or t[j - 3] in '([«"„“,')):
            return word
        i = j - 2
        word = t[i] + "." + word


def _opens(t: str, k: int, e: int, soft: bool) -> bool:
    """Whether what stands at ``k`` can open a sentence in a spaced script; ``soft``: after an ellipsis."""
    ch = t[k]
    m = TOKEN.match(t, k, e)
    token = m[0] if m else ch
    if ch.islower():
        return not soft and bool(re.search(r"[\d_]", token.rstrip(".,;:!?")))
    if ch.isalpha() or ch in "¿¡":
        return True
    if ch.isdigit():
        return not soft
    if ch in PAIRS or ch == '"':
        rest = token.lstrip("".join(PAIRS) + '"')
        nxt = t[k + 1 : e].lstrip()[:1] if not rest else rest[0]
        return bool(nxt) and not nxt.islower()
    if ch == ".":
        return len(token) > 1 and token[1].isalnum()
    if ch in "-–—*•#>@$/&~+§№•▪":
        return not soft
    return False


def _ends(t: str, b: int, e: int, i: int, j: int, g: int, quoted: bool) -> bool:
    """Whether the node at ``g``, after terminators t[i:j] and closing marks, is a boundary."""
    run = t[i:j]
    k = g
    while k < e and t[k].isspace():
        k += 1
    if k >= e:
        return True
    ch = t[k]
    closed = g > j
    if run[-1] in HARD or (SPACELESS.match(ch) and k == g and run[-1] in "!?"):
        if closed and SPACELESS.match(ch):
            lex = "ja" if KANA.match(ch) else "zh"
            word = lattice_words(SPACELESS_RUN.match(t, k, e)[0], _LEX[lex], _LONGEST[lex])[0]
            return word not in (JAPANESE_GOES_ON if lex == "ja" else CHINESE_GOES_ON)
        return ch not in "、，,;；：:"
    soft = run[-1] in "…‥" or run.endswith("..")
    if k == g:  # nothing between: only marks of scripts without blanks after them, or a spaceless letter after a full stop
        if SPACELESS.match(ch) and run == "." and not closed:
            return not t[i - 1 : i].isdigit() and _plain_stop(t, b, i, ch, e, k)
        return run[-1] in "।॥؟۔" and ch.isalpha() and not closed
    if soft and (i == b or t[i - 1].isspace()) and not ch.isupper():
        return False
    if not _opens(t, k, e, soft):
        return False
    if closed and quoted and ch.isalpha() and not ch.isupper() and not ch.islower():
        word = BARE.match(t, k, e)
        if word and (word[0] in CASELESS_GOES_ON):
            return False
    if run == "." and not closed:
        return _plain_stop(t, b, i, ch, e, k)
    return True


def _plain_stop(t: str, b: int, i: int, ch: str, e: int, k: int) -> bool:
    """A single period at ``i`` with an opening word at ``k``: is it a full stop?"""
    word = _abbreviation(t, b, i)
    low = word.lower()
    if low in BEFORE_DIGIT:
        return not ch.isdigit() and not (low in ("fig", "art", "п", "см") and ch.isalpha())
    if low in ALWAYS:
        return False
    if low in SOMETIMES or re.fullmatch(r"(?:\w\.)+\w", low):
        return ch.isupper() or (ch.isalpha() and not ch.islower()) or ch in '("«„“[¿¡'
    if len(word) == 1 and word.isalpha() and (word.isupper() or INITIAL.match(t, k, e)):
        return False  # an initial, or the first part of an abbreviation such as "z. B."
    d = i
    while d > b and t[d - 1].isdigit():
        d -= 1
    if 1 <= i - d <= 2 and (d == b or t[d - 1].isspace()):
        nxt = re.compile(r"\w+").match(t, k, e)
        if nxt and nxt[0].lower() in ORDINAL_NOUNS:
            return False
        if not t[b:d].strip():  # the number of a list item
            return False
    return True


def _script(run: str) -> str:
    return "lao" if run[0] >= "\u0e80" else "thai"


def _run_words(run: str, lex: Words) -> tuple[str, str]:
    """The first and the last word of a whole run of letters."""
    words = lattice_words(run, lex.known, lex.longest)
    return words[0], words[-1]


def _thai_gap(t: str, e: int, k: int, before: str | None, after: str | None, words: dict[str, tuple[str, str]], lexica: dict[str, Words]) -> bool:
    """A gap that ends at ``k`` in text of a script without spaces and periods, between two whole runs of letters.

    It is a boundary if the word before it is a particle that closes and the one after it does not carry the sentence on,
    or if the word before it does not carry on and the one after it opens.
    """
    if before is None:
        return False
    for run in (before, after):
        if run and run not in words:
            words[run] = _run_words(run, lexica[_script(run)])
    lex, last = lexica[_script(before)], words[before][1]
    if last in lex.goes_on:
        return False
    if after is None:  # another script: only after a word that closes, and if a sentence can open there
        nxt = TOKEN.match(t, k, e)
        opens = last in lex.known and t[k].isalpha() and t[k].isupper() and last not in lex.opens
        return bool(nxt) and (bool(SPACELESS.match(nxt[0])) or opens or (t[k].isalpha() and not t[k].isupper() and not t[k].islower()) or t[k] in "¿¡«„“")
    first, to = words[after][0], lexica[_script(after)]
    return first in to.opens or (last in lex.closes and first not in to.goes_on and first not in to.closes and first not in STILL_GOES_ON)


#: The least number of texts or blocks that a string must begin to be learnt, and the least part of all of them: so at most 10,000 strings of one length are learnt.
LEAST_STARTS, LEAST_SHARE = 20, 1e-4


def _blocks(t: str) -> list[tuple[int, int]]:
    """The parts of a text between blank lines, without white space around them."""
    found, at = [], 0
    for m in [*BLANK_LINE.finditer(t), None]:
        b, e = at, m.start() if m else len(t)
        at = m.end() if m else e
        while b < e and t[b].isspace():
            b += 1
        while e > b and t[e - 1].isspace():
            e -= 1
        if b < e:
            found.append((b, e))
    return found


def learn(df: DataFrame, text: str = "raw_text") -> dict[str, set[str]]:
    """Opening words of Thai and Lao in a corpus: {script: words}.

    Counted are the beginnings, up to forty code points, of runs that begin a block and of runs that follow a gap. A beginning is a word (or a phrase that
    always stands together) if the run ends after it at least every other time, or if it goes on in three ways or more, none of which makes up four
    fifths of it. It opens sentences if it begins blocks often (see LEAST_STARTS), and its part of the runs after gaps is at most twice
    its part of the blocks' beginnings.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str, bool]] = Counter()
            for t in batch.column(text).to_pylist():
                for b, e in _blocks(t):
                    for m in THAI_RUN.finditer(t, b, e):
                        if m.start() == b or t[m.start() - 1].isspace():
                            run = m[0][:41]
                            for n in range(2, min(40, len(run)) + 1):
                                seen[run[:n], run[n : n + 1], m.start() == b] += 1
            keys = list(seen)
            cols = [[k[0] for k in keys], [k[1] for k in keys], [seen[k] if k[2] else 0 for k in keys], [0 if k[2] else seen[k] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["w", "next", "starts", "gaps"])

    rows = df.select(text).where(F.col(text).rlike("[\u0e00-\u0eff]")).distinct().mapInArrow(count, "w string, next string, starts long, gaps long")
    lao = F.col("w") >= "\u0e80"
    ways = rows.groupBy("w", "next").agg(F.sum("starts").alias("starts"), F.sum("gaps").alias("gaps"))
    both = F.col("starts") + F.col("gaps")
    per = ways.groupBy("w").agg(F.sum("starts").alias("starts"), F.sum("gaps").alias("gaps"), F.count("*").alias("ways"), F.max(F.when(F.col("next") != "", both)).alias("main"), F.max(F.when(F.col("next") == "", both)).alias("ended"), F.first(lao).alias("lao"))
    two = per.where(F.length("w") == 2).groupBy("lao").agg(F.sum("starts").alias("all_starts"), F.sum("gaps").alias("all_gaps"))  # every run counts once
    enough = (F.col("starts") >= LEAST_STARTS) & (F.col("starts") >= F.col("all_starts") * LEAST_SHARE)
    word = (F.coalesce("ended", F.lit(0)) * 2 >= both) | ((F.col("ways") >= 3) & (F.coalesce("main", F.lit(0)) < both * 0.8))
    opens = F.col("gaps") * F.col("all_starts") <= 2 * F.col("starts") * F.col("all_gaps")
    found = {"thai": set(), "lao": set()}
    for r in per.join(two, "lao").where(enough & word & opens).select("w", "lao").collect():  # at most 10,000 of each length and script
        found["lao" if r["lao"] else "thai"].add(r["w"])
    return found


def sentence_spans(text: str | None, lexica: dict[str, Words] = LEXICA) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, in code points, end exclusive."""
    if text is None:
        return []
    t, out = text, []
    for b, e in _blocks(t):
        pairs = _pairs(t, b, e)
        opens = np.array([p[0] for p in pairs], int)
        cuts: list[tuple[int, int]] = []

        def holder(g: int) -> int:
            """Index of the pair that holds gap g, or -1."""
            x = int(np.searchsorted(opens, g)) - 1
            return x if x >= 0 and pairs[x][0] < g <= pairs[x][1] else -1

        for m in END.finditer(t, b, e):
            i, j = m.span()
            g, quoted = j, False
            while True:
                if g < e and t[g] in CLOSERS and holder(g) >= 0 and pairs[holder(g)][1] == g:
                    quoted = True
                    g += 1
                    continue
                gap = g
                while gap < e and t[gap] in " \xa0 ":
                    gap += 1
                if gap > g and gap < e and t[gap] in "»›" and holder(gap) >= 0 and pairs[holder(gap)][1] == gap:
                    quoted = True
                    g = gap + 1
                    continue
                if g < e and t[g] in CLOSERS and t[g] not in PAIRS and holder(g) >= 0:  # an inner mark before the outer one
                    inner = g
                    while inner < e and t[inner] in CLOSERS and t[inner] not in PAIRS:
                        inner += 1
                    if holder(inner) < 0:
                        g, quoted = inner, True
                        continue
                break
            if holder(g) >= 0 or (cuts and g <= cuts[-1][0]):
                continue
            start = cuts[-1][0] if cuts else b
            while start < i and t[start].isspace():
                start += 1
            if _ends(t, start, e, i, j, g, quoted):
                cuts.append((g, 0))
        if THAI_RUN.search(t, b, e):
            marks = {c[0] for c in cuts}
            runs = list(THAI_RUN.finditer(t, b, e))
            opened, closed = {m.start(): m[0] for m in runs}, {m.end(): m[0] for m in runs}
            words: dict[str, tuple[str, str]] = {}
            for m in re.compile(r"\s+").finditer(t, b, e):
                g, k = m.span()
                if g not in marks and holder(g) < 0 and _thai_gap(t, e, k, closed.get(g), opened.get(k), words, lexica):
                    marks.add(g)
            cuts = [(g, 0) for g in sorted(marks)]
        s = b
        for g, _ in [*cuts, (e, 0)]:
            x, y = s, g
            while x < y and t[x].isspace():
                x += 1
            while y > x and t[y - 1].isspace():
                y -= 1
            if x < y:
                out.append((x, y))
            s = g
    return out


def segment(df: DataFrame, key: str = "input_id", text: str = "raw_text") -> DataFrame:
    """(key, unit_no, unit_id, sent_start, sent_end, unit_text) of every sentence of each different (key, text)."""
    kind = df.schema[key].dataType.simpleString()
    lexica = {k: LEXICA[k].with_openers(v) for k, v in learn(df, text).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(key)
            texts = b.column(text).to_pylist()
            spans = [sentence_spans(t, lexica) for t in texts]
            n = np.array([len(s) for s in spans], np.int64)
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            no = np.concatenate([np.arange(1, k + 1) for k in n]) if len(n) else np.zeros(0, int)
            unit = [t[x:y] for t, s in zip(texts, spans) for x, y in s]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(no.astype(np.int32)), pa.array([f"E{i}" for i in no], pa.string()), pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(unit, pa.string())],
                names=[key, "unit_no", "unit_id", "sent_start", "sent_end", "unit_text"],
            )

    rows = df.select(key, text).where(F.col(text).isNotNull()).distinct()
    return rows.mapInArrow(run, f"`{key}` {kind}, unit_no int, unit_id string, sent_start int, sent_end int, unit_text string")


def units(df: DataFrame) -> DataFrame:
    """One row per different input id: sentences E1..En and evidence spans with the hash of each unit. Texts without a unit have empty maps."""
    s = segment(df)
    per = s.groupBy("input_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", "unit_id", "sent_start", "sent_end", "unit_text"))).alias("u"))  # the units of one text
    made = per.select(
        "input_id",
        F.map_from_entries(F.transform("u", lambda x: F.struct(x.unit_id, x.unit_text))).alias("sentences"),
        F.map_from_entries(F.transform("u", lambda x: F.struct(x.unit_id, F.struct(x.sent_start.alias("start"), x.sent_end.alias("end"), F.sha2(x.unit_text, 256).alias("text_sha256"))))).alias("evidence_spans"),
        F.size("u").alias("evidence_count"),
    )
    return df.select("input_id").distinct().join(made, "input_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
