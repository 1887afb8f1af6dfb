"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is a DataFrame expression or a Spark ML stage that runs in the JVM.  Judging a url needs no other row,
so there is no shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
SIZES = (3, 4, 5)
COLUMNS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Words that names of sites are made of.  Sites are invented from them; words of several kinds are never mixed.
UNWANTED = {
    "gambling": """casino poker slots bet bets betting jackpot roulette blackjack bingo lottery lotto gamble gambling wager
        bookmaker baccarat spin odds tipster freespins bonus apuestas wetten paris-sportifs gluecksspiel tragaperras""",
    "adult": """porn porno sex sexy xxx adult adults nude nudes cams camgirls webcam escort escorts erotic erotik hentai
        milf fetish hookup naked hardcore swingers stripper onlyhot lesbians sexo putas""",
    "pills": """pills viagra cialis pharma meds tramadol xanax steroids levitra ambien phentermine valium drugstore
        canadianmeds norx slimming weightloss dietpill potency tablets painkillers kamagra""",
    "spam": """spam spammer seo-links backlinks linkfarm bulkmail clickbait doorway massmail autoblog spinbot fakenews
        likesbot followers buyfollowers buylikes junkmail trafficbot linkexchange robocall""",
    "ads": """ads ad adserver adnet adclick banner banners popup popunder tracker tracking track pixel clickfarm affiliate
        retarget beacon adsystem adserv doubleads promo-ads syndication telemetry sponsor-ads""",
    "fraud": """phish phishing malware trojan scam fraud hacked keylogger ransom botnet spyware fakelogin verify-account
        account-update secure-login free-prize winner prize giveaway free-money easycash payday quickloan cryptodouble
        getrich replica fakewatches counterfeit""",
    "piracy": """warez crack cracks cracked keygen torrent torrents pirate piratebay serials nulled leaked freemovies
        putlocker streamfree downloadfull iptvfree rips modapk hackedgames""",
}
FILLERS = """online best top free cheap buy live vip royal lucky hot super real club zone world king direct 24 365 hub now
    easy max mega star city deal shop best4u xl pro""".split()  # fmt: skip
WANTED = {
    "news": """news daily herald gazette tribune chronicle journal times post courier observer reporter press magazine
        bulletin zeitung nachrichten tagblatt journal-local noticias diario periodico giornale monde figaro pais kurier""",
    "learning": """school university college academy institute library museum archive science physics chemistry biology
        mathematics history geology astronomy dictionary encyclopedia wiki research lecture student campus schule
        universidad bibliotheque escuela musee hochschule""",
    "public": """parliament council ministry government court police fire-station health hospital clinic doctor dentist
        pharmacy-board embassy customs census weather climate railway airport harbour transit mairie gemeinde rathaus
        ayuntamiento salud""",
    "culture": """theatre orchestra opera poetry novel painting gallery cinema film music jazz choir guitar festival
        photography design architecture dance ballet sculpture theater kunst cultura livres""",
    "home": """garden gardening recipes kitchen bakery cooking bread cheese coffee tea wine furniture carpenter plumber
        painter knitting sewing pets horse parenting baby market farm farmers orchard bees jardin cuisine cocina garten""",
    "outdoors": """mountain river forest lake valley hiking cycling running football tennis swimming chess sailing skiing
        camping travel journey hotel hostel map atlas island coast birds nature wandern viajes montagne voyage""",
    "work": """software code developer python linux database cloud open-source hardware robotics engineering electric
        energy solar bank insurance accounting lawyer notary logistics freight steel printing books bookshop shoes
        clothing bicycle auto garage jobs careers estate trade""",
}
PLAIN_FILLERS = """the my our green north south old new blue red first little central national royal local st club house group
    association society online city world shop today center 21 net lab union alliance haus""".split()  # fmt: skip
# Syllables of coined names, which say nothing: such sites are wanted.
ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sh sk sl st t th tr v w x z".split()
VOWELS = "a e i o u ai ea io oo ou".split()
CODAS = ["", "", "l", "n", "r", "s", "t", "nd", "ck", "ng", "th", "m"]
TOPS = "com net org com de fr es info com io co.uk it eu org com nl".split()
HEADS = ("", "www.", "", "m.", "blog.", "www.", "", "shop.")
PATHS = (
    "/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}?page=2", "", "/index.html", "/about", "/articles/{n}", "/category/{w}",
    "/{w}/{n}", "/{w}", "/2021/05/{w}.html", "/contact/", "/search", "/p/{n}",
)
#: Sites per word and kind of name, and coined names.
PARTNERS, COINED, PAGES = 6, 900, 2


def _coined(i: int) -> str:
    """The ``i``-th coined name: two or three syllables."""
    parts, state = [], i * 2_654_435_761 + 12_345
    for _ in range(2 + i % 2):
        for choice in (ONSETS, VOWELS, CODAS):
            state = (state * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % (1 << 64)
            parts.append(choice[(state >> 33) % len(choice)])
    return "".join(parts)


def _sites(kinds: dict[str, str], fillers: list[str]) -> list[tuple[str, str]]:
    """Names of sites, each with a word for its paths: single words, and words with fillers and with others of their kind."""
    made: dict[str, str] = {}
    for words in map(str.split, kinds.values()):
        for i, word in enumerate(words):
            made[word] = words[i - 1]
            for k in range(PARTNERS):
                filler = fillers[(5 * i + 7 * k) % len(fillers)]
                other = words[(i + 1 + 3 * k) % len(words)]
                joint = ("-", "")[k % 2]
                made[joint.join((filler, word) if k % 4 < 2 else (word, filler))] = other
                if other != word:
                    made[joint.join((word, other))] = word
    return list(made.items())


def _pages(names: list[tuple[str, str]]) -> list[str]:
    return [
        f"http{'s' * ((i + k) % 2)}://{HEADS[(3 * i + k) % len(HEADS)]}{name}{'.example' * (i % 4 == 0)}."
        f"{TOPS[(i + 5 * k) % len(TOPS)]}{PATHS[(7 * i + 3 * k) % len(PATHS)].format(n=37 * i + k, w=word)}"
        for i, (name, word) in enumerate(names)
        for k in range(PAGES)
    ]


def labelled_sites() -> dict[int, list[tuple[str, str]]]:
    """Per label (1: block) the invented names of sites, each with a word for its paths."""
    coined = [(_coined(i), _coined(i + COINED)) for i in range(COINED)]
    return {1: _sites(UNWANTED, FILLERS), 0: _sites(WANTED, PLAIN_FILLERS) + coined}


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default table: columns ``url`` and ``label``, several thousand rows."""
    made = "\n".join(f"{url} {label}" for label, names in labelled_sites().items() for url in _pages(names))
    lines = spark.range(1, numPartitions=1).select(F.explode(F.split(F.lit(made), "\n")).alias("line"))
    parts = F.split(F.col("line"), " ")
    return lines.select(parts[0].alias("url"), parts[1].cast("int").alias("label"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for a url without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``rule``, ``verdict`` of the longest rule that fits, or null; equal lengths go to the later in order.

    The rules are a parameter, written into the plan.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(best)
    return best


def _ngrams(mark: str, chars: Column) -> list[Column]:
    """Runs of characters, each marked with where it comes from; one at least.

    Single elements are looked up, because a slice of an array takes as long as the whole array.
    """

    def runs(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(chars) - size))
        return F.transform(starts, lambda i: F.concat_ws("", F.lit(mark), *[F.get(chars, i + k) for k in range(size)]))

    return [runs(size) for size in SIZES]


def _prepared(urls: DataFrame, url: Column) -> DataFrame:
    """Host, path and their n-grams.  Characters are split off first: looking them up in a long text takes long."""
    host, path = host_and_path(url)

    def chars(text: Column) -> Column:
        return F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    split = urls.withColumns({"_host": host, "_path": path})
    # Digits of a path are page numbers.
    split = split.withColumns(
        {"_host_chars": chars(F.col("_host")), "_path_chars": chars(F.regexp_replace("_path", "[0-9]", "0"))}
    )
    grams = F.concat(*_ngrams("h", F.col("_host_chars")), *_ngrams("p", F.col("_path_chars")))
    return split.withColumn("_ngrams", grams)


def train(labelled: DataFrame) -> PipelineModel:
    """Fit on a small table with columns ``url`` and ``label`` (1: block)."""
    rows = _prepared(labelled, F.col("url")).select("_ngrams", F.col("label").cast("double").alias("_label"))
    counts = HashingTF(inputCol="_ngrams", outputCol="_counts", numFeatures=COLUMNS, binary=True)
    regression = LogisticRegression(
        featuresCol="_counts", labelCol="_label", probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_predicted", regParam=0.0004, standardization=False, maxIter=60,
    )
    return Pipeline(stages=[counts, regression]).fit(rows.where(F.col("_label").isNotNull()).coalesce(1))


def judge(urls: DataFrame, url: str, rules: Sequence[Rule], model: PipelineModel) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (0 to 1, by the model).

    The verdict is the rule's, else block if the score is 0.5 or more.  A url that has neither host nor path is
    judged by the model like any other: it holds no unwanted n-gram.  ``urls`` may have any columns but the five
    and those that begin with an underscore.
    """
    found = _prepared(urls, F.col(url)).withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules))
    score = vector_to_array("_probability")[1]
    return model.transform(found).select(
        *urls.columns,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(score >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        score.alias("block_score"),
    )
