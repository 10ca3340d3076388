"""Quality rules against plain counts, and verdicts on prose and noise."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from loomsift.llm.common import documents, vocabulary
from loomsift.llm.quality import PIECE_BPE, keep_good, measure, piece_words, quality_measures, repeated_words, script_of
from loomsift.llm.suite import queries

VOCAB = vocabulary(PIECE_BPE)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n)


def base(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in df.collect()), key=repr)


def test_op9_whole_table(spark, sf):
    df = queries()["op9_quality_rules"](spark, sf)
    docs = documents(spark, sf).collect()
    assert base(df) == sorted(((r.doc_id, *brute(r.text)) for r in docs), key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=VOCAB)
    tokens = {r.doc_id: sum(len(library.encode(w)) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs}
    for r in df.collect():
        assert r.n_tokens == tokens[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_op9_odd(spark, odd_docs, no_docs, wide):
    assert base(quality_measures(wide(odd_docs), VOCAB)) == sorted(((r.doc_id, *brute(r.text)) for r in odd_docs.collect()), key=repr)
    assert quality_measures(no_docs, VOCAB).collect() == []
    kept = keep_good(wide(odd_docs), VOCAB)
    assert kept.columns == wide(odd_docs).columns and kept.count() == sum(r.kept for r in quality_measures(odd_docs, VOCAB).collect())


@pytest.mark.parametrize("seed", range(20))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(0, 60))]
    for size in (1, 2, 3, 5, 8):
        windows = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
        count = Counter(windows)
        assert repeated_words(np.array(words, np.int64), size) == len({j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + size)})


def verdict_of(text):
    return measure(text, piece_words(VOCAB))[6]


def test_verdicts():
    prose = {
        "en": "The committee met on Tuesday to discuss the new harbour plan, and several members asked for more time to read it.",
        "de": "Der Ausschuss traf sich am Dienstag, um den neuen Plan für den Hafen zu besprechen, und einige baten um mehr Zeit.",
        "ru": "Комитет собрался во вторник, чтобы обсудить новый план гавани, и несколько членов попросили больше времени на чтение.",
        "el": "Η επιτροπή συνεδρίασε την Τρίτη για να συζητήσει το νέο σχέδιο του λιμανιού και αρκετά μέλη ζήτησαν περισσότερο χρόνο.",
        "zh": "委员会 星期二 开会 讨论 新的 港口 计划， 几位 成员 要求 更多 时间 阅读 它， 主席 同意了。 下次 会议 在 十月。",
    }
    for lang, text in prose.items():
        assert verdict_of(text), lang
    rng = random.Random(2)
    noise = " ".join("".join(chr(rng.randrange(0x1F300, 0x1F900)) for _ in range(6)) for _ in range(40))
    assert not verdict_of(" ".join(f"{c}{i}" for i in range(40) for c in "\x01\x02\x03")) and not verdict_of("Ab " + noise + " word" * 0)
    assert not verdict_of(" ".join(["a" * k for k in range(100, 140)]))
    assert script_of("Комитет abc") == "cyrillic" and script_of("naïve Straße") == "latin" and script_of("") == "latin"


def random_words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 10))) for _ in range(n))


def cut(text, size):
    return " ".join(text[i:i + size] for i in range(0, len(text), size))


@pytest.mark.parametrize("seed", range(3))
def test_noise_is_outside(seed):
    rng = random.Random(seed)
    ascii_letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (40, 400, 2000):
        noise = {"base64": cut(base64.b64encode(rng.randbytes(n * 8)).decode(), 12), "hex": cut(rng.randbytes(n * 4).hex(), 8),
                 "printable": random_words(rng, [chr(c) for c in range(33, 127)], n), "capitals": random_words(rng, ascii_letters.upper(), n),
                 "thai": random_words(rng, [chr(c) for c in range(0xE01, 0xE3B)], n), "han": random_words(rng, [chr(c) for c in range(0x4E00, 0x9FA6)], n),
                 "cyrillic": random_words(rng, [chr(c) for c in range(0x430, 0x450)], n), "hangul": random_words(rng, [chr(c) for c in range(0xAC00, 0xD7A4)], n)}
        if n > 40:
            noise["letters"] = random_words(rng, ascii_letters, n)
        for kind, text in noise.items():
            found = measure(text, piece_words(VOCAB))
            assert not found[5] and not found[6], (kind, n)
    # Fewer than 50 tokens are judged too.
    short = cut(rng.randbytes(11).hex(), 2)
    found = measure(short, piece_words(VOCAB))
    assert found[8] < 50 and not found[5] and not found[6]


@pytest.mark.parametrize("text", [
    "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı.",
    "Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvisku.",
    "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn ti làákàyè àti ti ẹ̀rí-ọkàn.",
    "Барлық адамдар тумысынан азат және қадір-қасиеті мен құқықтары тең болып дүниеге келеді. Адамдарға ақыл-парасат, ар-ождан берілген.",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है।",
    "มนุษย์ทั้งหลาย เกิดมา มีอิสระ และ เสมอภาคกัน ใน เกียรติศักดิ์ และ สิทธิ ต่าง มี เหตุผล และ มโนธรรม และ ควรปฏิบัติ ต่อกัน",
    "すべての 人間は、 生まれながらにして 自由であり、 かつ、 尊厳と 権利とについて 平等である。 人間は、 理性と 良心とを 授けられており、",
    "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며",
    "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ",
    "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი"])
def test_prose_is_inside(text):
    assert measure(text, piece_words(VOCAB))[5:7] == (False, True)
