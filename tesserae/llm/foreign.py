"""Natural language hidden inside code.

Method: compression-based identification. For each language a zstandard dictionary of labelled text
(the documents table, a bounded sample of ``LABELLED_DOCS`` documents a language, plus a short
bundled seed) is built; a passage is encoded with every dictionary and the shortest encoding wins.
A margin over the English and the code dictionary rejects English, names and code-like passages.
Only passages with words unlike English reach the encoders: words learnt from the same labelled
text, letters outside ASCII, or another script. Cyrillic, kana and Han are told by script first.

Written forms: plain, ``\\u`` escapes, character references, UTF-8 read as a one-byte code page, and
letters without their marks (``ue`` for u-umlaut).

Defined results: null and empty texts have no passages; a lone foreign word, fewer than three words
or fewer than ``SHORT`` Han or kana signs are no passage, nor are fewer than ``CLAUSE`` unless their words or particles make
them a clause (a name isn't); Cyrillic words of one letter count beside two longer ones; repeated rows count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("de", "fr", "es", "pt", "it", "pl", "ru", "zh", "ja")
LATIN = ("de", "fr", "es", "pt", "it", "pl")
#: Labelled documents a language of which dictionaries are built; a fixed bound at any size.
LABELLED_DOCS = 150
#: Bytes of text in one dictionary.
DICTIONARY_BYTES = 60_000
#: A foreign encoding must be at most this share of the English and the code encoding.
MARGIN = 0.94
#: Words and signs of the shortest passage.
WORDS, CLAUSE = 3, 5
#: Signs in a row of the shortest passage that must be told from a name, and characters of the shortest ASCII span that is read.
SHORT, SPAN = 3, 8

#: Words as which a smaller English or code sample counts when words are compared.
LEAST_WORDS = 5_000

# Seed text of each language, used beside the labelled documents.
_SEED = {
    "en": "the of and to in is that it for was on are as with they be at one have this from by not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "de": "der die das und ist nicht mit ein eine einen dem den des für auf wird werden oder wenn bei nach aus zu von im sich auch noch nur keine wurde kann sind war als über vor durch diese dieser muss hier alle mehr sehr ohne zwischen während immer bereits falls damit weil",
    "fr": "le la les des une un est pas dans pour que qui avec sur par plus cette ce ces son sa ses nous vous ils elle être avoir fait sont été mais ou où donc car si leur tout tous sans aussi après avant depuis pendant chaque entre très même comme quand lorsque afin",
    "es": "el la los las una un es no en para que con por más esta este su sus se lo como pero cuando donde si sin sobre también hasta desde entre muy todo todos ya ser fue son está están hay cada después antes según mientras porque aunque",
    "pt": "o a os as uma um é não em para que com por mais esta este seu sua se como mas quando onde sem sobre também até desde entre muito todo todos já ser foi são está estão há cada depois antes conforme enquanto porque ao dos das nos nas pelo pela",
    "it": "il lo la gli le una un è non in per che con da più questa questo suo sua si come ma quando dove se senza su anche fino dopo prima tra molto tutto tutti già essere stato sono ogni mentre perché del della dei delle nel nella alla dal dalla",
    "pl": "nie jest to się na w z do że i o jak po co ale czy za od przez przy dla tak był była było są być może tylko już gdy jeśli bez oraz lub ten ta tego każdy każda wszystkie przed między ponieważ żeby",
}
_SEED_CODE = "get set return this null true false public private static void int string list map new import package class extends implements logger log error debug info warn select from where order by limit insert update delete http https www com org net java util src main test http://localhost utf-8 %s %d foo bar"

_EXT_RX = {
    "c": re.compile(r"/\*(?P<b>(?s:.*?))\*/|//(?P<l>[^\n]*(?:\n[ \t]*//[^\n]*)*)|\"\"\"(?P<t>(?s:.*?))\"\"\"|\"(?P<s>(?:[^\"\\\n]|\\.)*)\"|'(?P<q>(?:[^'\\\n]|\\.)*)'|`(?P<p>(?:[^`\\]|\\(?s:.))*)`"),
    "py": re.compile(r"(?P<b>\b\B)|\"\"\"(?P<t>(?s:.*?))\"\"\"|'''(?P<p>(?s:.*?))'''|#(?P<l>[^\n]*(?:\n[ \t]*#[^\n]*)*)|\"(?P<s>(?:[^\"\\\n]|\\.)*)\"|'(?P<q>(?:[^'\\\n]|\\.)*)'"),
    "xml": re.compile(r"<!--(?P<b>(?s:.*?))-->|(?P<t>\b\B)|(?P<p>\b\B)|(?P<l>\b\B)|=\s*\"(?P<s>[^\"<]*)\"|=\s*'(?P<q>[^'<]*)'"),
    "json": re.compile(r"(?P<b>\b\B)|(?P<t>\b\B)|(?P<p>\b\B)|(?P<l>\b\B)|\"(?P<s>(?:[^\"\\\n]|\\.)*)\"|(?P<q>\b\B)"),
}
_UESC = re.compile(r"\\u+([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]{1,6})\}|\\x([0-9a-fA-F]{2})")
_MOJIBAKE = re.compile("[ÃÂÄÅÐÑãäåæçè][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]")
_LINE_LEAD = re.compile(r"(?m)^[ \t]*(?:\*+(?!/)|//+|#+)?[ \t]?")
_CUT = re.compile(r"(?<=[.!?:;])\s+|[。！？；]|\n[ \t]*\n|\n(?=[ \t]*@)|\\n|@(?:param|return|throws|see|author|since|deprecated)\b")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CYRILLIC, _KANA, _HAN = re.compile("[Ѐ-ӿ]+"), re.compile("[぀-ヿｦ-ﾟ]"), re.compile("[㐀-鿿豈-﫿]")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ々ー]")
_CJK_RUN = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ々ー]{%d,}" % SHORT)
# Words that make a few signs a clause, particles and endings of Japanese, signs only Japanese has, family names of Chinese.
_PREDICATE = re.compile(
    "[不无無没沒未已请請了吗嗎吧被把]|失败|失敗|成功|错误|錯誤|异常|異常|超时|超時|完成|完毕|完了|开始|開始|结束|結束|終了|取消|中止|删除|刪除|削除|保存|更新|添加|新增|修改|変更|加载|加載|连接|連接|接続|登录|登錄|登録|注册|註冊|输入|輸入|输出|輸出|入力|出力|查询|查詢|查找|获取|獲取|取得|设置|設置|設定|返回"
    "|读取|讀取|写入|寫入|打开|打開|关闭|關閉|启动|啟動|起動|停止|检查|檢查|確認|确认|创建|創建|作成|处理|處理|処理|发送|發送|送信|受信|接收|提交|上传|上傳|下载|下載|解析|验证|驗證|检验|選択|选择|執行|执行|実行|调用|調用|转换|轉換|计算|計算|判断|忽略|跳过|等待|重试|退出|存在|支持|需要|必须|必須"
)
_PARTICLE = re.compile("です|ます|ません|ください|できない|[ァ-ヺ㐀-鿿ー](?:した|して|する|され|ない)|[ぁ-ゖ]ない$|[㐀-鿿][ぁ-ゖ]{0,2}(?:れる|った)|[ァ-ヺ㐀-鿿ー][をがはにへで](?:[ぁ-ゖァ-ヺ㐀-鿿]|$)")
_JAPANESE = set("続込読図対応発実変単戻検択権済帰気駅働円広売価験残様毎処録")
_FAMILY_NAMES = set("王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何林罗羅高郑鄭梁谢謝宋唐许許邓鄧冯馮韩韓曹曾彭萧蕭蔡潘田董袁于余叶葉蒋蔣杜苏蘇魏程吕呂丁沈任姚卢盧傅钟鐘姜崔谭譚廖范汪陆陸金石戴贾賈韦韋夏邱方侯邹鄒熊孟秦白江阎閻薛尹段雷黎史龙龍陶贺賀顾顧毛郝龚龔邵万萬钱錢严嚴")
_GERMAN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"})
_POLISH = str.maketrans("łŁ", "lL")
_QUICK = re.compile(r"[^\x00-\x7f]|\\u[0-9a-fA-F]{4}|&[a-zA-Z#]\w*;")


def fold(text: str, lang: str = "") -> str:
    """``text`` without its marks, as people write it on a keyboard that lacks them."""
    if lang == "de":
        text = text.translate(_GERMAN)
    return "".join(c for c in unicodedata.normalize("NFD", text.translate(_POLISH)) if not unicodedata.combining(c))


def decode(span: str) -> str:
    """A span as its reader sees it."""
    if "\\" in span:
        span = _UESC.sub(lambda m: chr(n) if (n := int(m[1] or m[2] or m[3], 16)) < 0x110000 and not 0xD800 <= n < 0xE000 else " ", span)
    if "&" in span:
        span = html.unescape(span)
    if not span.isascii():
        if _MOJIBAKE.search(span):
            for page in ("cp1252", "latin-1"):
                try:
                    span = span.encode(page).decode("utf-8")
                    break
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
            else:
                span = _unmix(span)
        span = unicodedata.normalize("NFC", span)
    return span


def _unmix(span: str) -> str:
    """Mojibake in part of a span: each run of high characters is turned back by itself where it can be."""
    def back(m):
        for page in ("cp1252", "latin-1"):
            try:
                return m[0].encode(page).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        return m[0]

    return re.sub(r"[^\x00-\x7f]+", back, span)


def spans_of(text: str, ext: str) -> Iterator[str]:
    """The comments and string literals of a file."""
    for m in _EXT_RX["c" if ext in ("java", "js") else ext if ext in _EXT_RX else "c"].finditer(text):
        kind = m.lastgroup
        s = m[kind] if kind else ""
        if s and (len(s) >= SPAN or not s.isascii()):
            yield _LINE_LEAD.sub("", s) if kind in ("b", "l", "t") else s


class Identifier:
    """Language of a passage by the shortest zstandard encoding. Made from a dict of labelled texts."""

    def __init__(self, labelled: dict[str, list[str]], code: list[str]):
        texts = {k: [_SEED[k], *labelled.get(k, [])] for k in _SEED}
        counts = {k: Counter(w.lower() for t in v for w in _WORD.findall(t)) for k, v in texts.items()}
        total = {k: sum(c.values()) or 1 for k, c in counts.items()}
        code_words = Counter(w.lower() for t in code for w in _WORD.findall(t))
        english = counts["en"]
        # small tables prove little about English: their absence counts as in a text of some length
        n_english, n_code = max(total["en"], LEAST_WORDS), max(sum(code_words.values()), LEAST_WORDS)
        self.lexicon: set[str] = set()
        for k in LATIN:
            for w, n in counts[k].items():
                if len(w) > 1 and n / total[k] > 12 * (english[w] + 0.2) / n_english and n / total[k] > 6 * (code_words[w] + 0.2) / n_code:
                    self.lexicon |= {w, fold(w, k)}
        self.lexicon -= {w for w in english if english[w] >= 3 and all(english[w] / total["en"] >= counts[k][w] / total[k] for k in LATIN)}
        self.votes: dict[str, dict[str, float]] = {}
        for k in LATIN:
            for w, n in counts[k].items():
                for v in {w, fold(w, k)} & self.lexicon:
                    self.votes.setdefault(v, {})[k] = max(n / total[k], self.votes.get(v, {}).get(k, 0))
        self.parts = {k: ("\n".join([*v, *(fold(t, k) for t in v if k != "en")]).encode()[-DICTIONARY_BYTES:]) for k, v in texts.items()}
        self.parts["code"] = "\n".join([_SEED_CODE, *code]).encode()[-DICTIONARY_BYTES:]
        self.made = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "votes": self.votes, "parts": self.parts, "made": None}

    def lengths(self, passage: str) -> dict[str, int]:
        import zstandard as z

        if self.made is None:
            self.made = {}
            for k, data in self.parts.items():
                d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=9)
                self.made[k] = z.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = passage.encode()
        return {k: len(c.compress(raw)) for k, c in self.made.items()}

    def latin(self, passage: str) -> str | None:
        n = {k: v - 8 for k, v in self.lengths(passage).items()}
        best = min(LATIN, key=lambda k: (n[k], k))
        near = [k for k in LATIN if n[k] <= n[best] + 1]
        if len(near) > 1:  # encodings come in whole bytes; where they tie, the words' shares in the labelled text decide
            share = dict.fromkeys(near, 0.0)
            for w in _WORD.findall(passage.lower()):
                v = self.votes.get(w, {})
                top = sum(v.values())
                for k in near:
                    share[k] += v.get(k, 0) / top if top else 0
            best = max(near, key=lambda k: (share[k], -n[k], k))
        return best if n[best] <= MARGIN * min(n["en"], n["code"]) else None

    def passages(self, text: str, ext: str) -> Iterator[tuple[str, str]]:
        """(language, passage) of each foreign passage of a file."""
        lexicon = self.lexicon
        for span in spans_of(text, ext):
            special = _QUICK.search(span) is not None
            if not special and not any(w in lexicon for w in span.lower().split()):
                continue
            shown = decode(span) if special else span
            for piece in _CUT.split(shown):
                if piece and (len(piece) >= 4 or not piece.isascii()):
                    lang = self.piece(piece)
                    if lang:
                        yield lang, piece.strip()

    def piece(self, piece: str) -> str | None:
        if not piece.isascii():
            cjk = _CJK.findall(piece)
            if len(cjk) >= CLAUSE:
                kana = len(_KANA.findall(piece))
                if kana >= 2 or kana and kana >= 0.1 * len(cjk):
                    return "ja"
                if len(_HAN.findall(piece)) >= CLAUSE:
                    return "zh"
            for run in _CJK_RUN.findall(piece) if len(cjk) >= SHORT else ():
                if lang := self._clause(run):
                    return lang
            cyrillic = _CYRILLIC.findall(piece)
            if len(cyrillic) >= WORDS and sum(len(w) > 1 for w in cyrillic) >= WORDS - 1:
                return "ru"
        words = _WORD.findall(piece)
        if len(words) < WORDS:
            return None
        lexicon = self.lexicon
        at = [i for i, w in enumerate(words) if (v := w.lower()) in lexicon or not w.isascii() and ("À" <= w[0] or any("À" <= c <= "ž" for c in w)) or "'" in v and v.split("'")[-1] in lexicon]
        if len(at) < 2:
            return None
        run = self._run(at)
        if run is None:
            return None
        a, b = run
        passage = piece if b - a + 1 >= 0.7 * len(words) else " ".join(words[max(0, a):b + 1])
        return self.latin(passage)

    @staticmethod
    def _clause(run: str) -> str | None:
        """Language of a few Han or kana signs that are a clause; None for a name or a lone noun."""
        if _KANA.search(run):
            return "ja" if _PARTICLE.search(run) or _HAN.search(run) and _PREDICATE.search(run) else None
        if not _PREDICATE.search(run) or len(run) <= SHORT and run[0] in _FAMILY_NAMES:
            return None
        return "ja" if _JAPANESE & set(run) else "zh"

    @staticmethod
    def _run(at: list[int]) -> tuple[int, int] | None:
        """The longest stretch between marked words in which at most two unmarked ones stand in a row."""
        best, i = None, 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] - at[j] <= 3:
                j += 1
            n = at[j] - at[i] + 1
            if n >= WORDS and j - i + 1 >= max(2, 0.4 * n) and (best is None or n > best[1] - best[0] + 1):
                best = (at[i], at[j])
            i = j + 1
        return best


_NO_PROSE = re.compile(r"[;{}=]\s*$|^\s*(?:at |import |package |@|java |\$|>|```)|\w\.\w+\(|://")


def prose(text: str) -> str:
    return "\n".join(x.strip(" -*#/>") for x in text.replace("\r", "").split("\n") if len(x) > 20 and not _NO_PROSE.search(x))


def labelled_sample(documents: DataFrame) -> tuple[dict[str, list[str]], list[str]]:
    """At most ``LABELLED_DOCS`` documents a language (those of the smallest id hash) as prose, and as
    many source documents as code. Ids are ranked first, so the text is read once and only for the sample's rows."""
    docs = documents.where("text is not null and lang is not null")
    key = F.when((F.col("kind") == "source") & (F.col("lang") == "en"), "code").otherwise(F.col("lang"))
    ids = docs.select("doc_id", key.alias("label"), F.xxhash64("doc_id").alias("h")).where(F.col("label").isin(*_SEED, "code"))
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).where(F.col("r") <= LABELLED_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(ranked.select("doc_id", "label")), "doc_id").select("doc_id", "label", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: r.doc_id):
        texts.setdefault(r.label, []).append(r.text if r.label == "code" else prose(r.text))
    code = texts.pop("code", [])
    return clean(texts, code), code


def clean(texts: dict[str, list[str]], code: list[str]) -> dict[str, list[str]]:
    """Labels are wrong now and then: lines that a first set of dictionaries gives to another language are left out."""
    first, out = Identifier(texts, code), {}
    for k, v in texts.items():
        keep = []
        for t in v:
            for line in t.split("\n"):
                if line and (n := first.lengths(line))[k] <= min(n[x] for x in _SEED) + 2:
                    keep.append(line)
        out[k] = ["\n".join(keep)]
    return out


def _batch_rows(ident: Identifier, b: pa.RecordBatch) -> list[tuple]:
    out = []
    for project, file, text in zip(*(b.column(i).to_pylist() for i in range(3))):
        chars: Counter = Counter()
        passages: Counter = Counter()
        for lang, p in ident.passages(text, file.rpartition(".")[2].lower()):
            chars[lang] += len(p)
            passages[lang] += 1
        out += [(project, file, lang, n, passages[lang], len(text)) for lang, n in chars.items()]
    return out


SHARES = "project string, file string, lang string, chars bigint, passages bigint, file_chars bigint"


def shares(corpus: DataFrame, documents: DataFrame) -> DataFrame:
    """(project, file, lang, chars, passages, file_chars) for each file and foreign language in it.

    Files are read where they are stored; only rows of files with foreign text are shuffled."""
    labelled, code = labelled_sample(documents)
    shared = corpus.sparkSession.sparkContext.broadcast(Identifier(labelled, code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = shared.value
        for b in batches:
            rows = _batch_rows(ident, b)
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], SHARES.replace(",", "").split()[::2])

    return corpus.select("project", "file", "text").where("file is not null and text is not null and text <> ''").mapInArrow(run, SHARES).distinct()


def _tables(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/raw_corpus.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return shares(*_tables(spark, sf_dir)).select("project", "file", "lang").distinct()


def p2_shares(spark, sf_dir: str) -> DataFrame:
    """The share of each foreign language in each file's characters."""
    return shares(*_tables(spark, sf_dir)).withColumn("share", F.round(F.col("chars") / F.col("file_chars"), 6))
