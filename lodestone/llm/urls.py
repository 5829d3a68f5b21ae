"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path). A rule fits its host and all subdomains of it, if the path starts with the rule's; the longest wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: The labelled table: addresses with a path each, as a crawl team marks what it knows. Adult, gambling, medicine spam, money, ads and trackers, pirated software, link and content farms, fraud.
BLOCKED = """
www.xvideos.com/video-new/48 redtube.com/categories youporn.com/watch/88231 www.sexcams-live.net/models/anna hotpornclips.tv/latest freexxxmovies.org/tags/amateur www.nakedgirls.pics/gallery/9 escorts-london.net/profiles/22
adultfriend-dating.com/join milfporn.club/videos/page/3 webcamsex.eu/online xxx-tube-hd.com/view/7712 sexchat24.net/rooms/3 pornpics-daily.com/set/188 livesexshow.tv/free www.eroticstories.xxx/story/91 nude-celebs.info/a/list hentai-porn.net/manga/4
www.pokerstars.net/poker/download betway-bonus.com/register 888casino.com/slots www.williamhill-bets.com/football/odds slots-jackpot-online.com/play onlinecasino-bonus.net/review/12 bestpokerrooms.org/offers livebetting24.com/odds/today
freespins-casino.co/no-deposit roulette-strategy-win.net/system sportsbetting-tips.win/picks/88 casinoroyal-online.bet/lobby bingo-jackpots.co.uk/join www.lottery-winners.top/claim sportbet247.com/live megaslots.games/spin betting-odds-king.com/tips/5 baccarat-casino.vip/table/2
cheapviagra-online.com/order buycialis-noprescription.net/cart canadian-pharmacy-rx.com/catalog/ed pills-discount.org/viagra weightloss-pills.shop/buy discount-meds-online.net/checkout xanax-cheap.com/order/now steroids-buy-online.net/shop
noprescription-pharmacy.biz/item/33 cheap-pills24.com/tramadol diet-pills-review.info/best generic-meds-cheap.com/levitra hair-loss-pills.net/buy/1 buy-ambien-online.org/price
paydayloans-fast.com/apply instant-cash-loans.net/form bad-credit-loan.info/approve make-money-fast.biz/start earn-cash-online.top/signup crypto-doubler.io/deposit bitcoin-giveaway.live/send forex-profit-robot.com/demo free-giftcards.win/claim
get-rich-quick.co/secret quick-loans-no-check.com/apply win-free-iphone.club/survey free-prize-winner.top/spin binaryoptions-profit.net/trade
ads.adnetwork-popunder.com/serve click.adtracker.net/redirect pixel.trackingserver.io/collect popads-media.com/tag banner-ads-exchange.com/show adserver.bannerfarm.net/delivery affiliate-clicks.biz/go/881 tracker.statcounter-ads.com/hit ad.clickserve-media.net/imp retarget-pixel.com/sync
adclick-tracking.com/c/19 popunder-ads.net/js/load cpa-affiliate-offers.com/landing/4 adserving-track.net/event
warez-downloads.net/cracks serials-keygen.ru/list cracked-software-free.com/download/55 torrent-pirate-movies.to/top freemovies-stream-hd.cc/watch/12 nulled-scripts.org/forum/thread/9 keygen-crack-serial.com/photoshop fullversion-crack.info/office
buy-backlinks-seo.com/packages seo-linkfarm.net/directory/a cheap-essay-writing.biz/order spam-comments-bot.com/pricing article-spinner-seo.net/tool free-backlinks-submit.info/add linkfarm-exchange.biz/swap buyfollowers-cheap.com/instagram contentfarm-clickbait.com/you-wont-believe/7 replica-watches-cheap.com/rolex
fake-handbags-outlet.net/sale cheapjerseys-wholesale.us/nfl clickbait-viral-news.click/shock/3 spamlinks-directory.info/c/2
paypal-login-verify.com/account secure-bank-update.info/signin appleid-unlock-support.net/verify phishing-kit-store.ru/buy account-suspended-alert.com/login scam-lottery-office.com/winner fake-antivirus-scan.net/alert virus-alert-support.com/call free-robux-generator.net/get password-stealer.biz/panel
""".split()
ALLOWED = """
en.wikipedia.org/wiki/Photosynthesis www.gutenberg.org/ebooks/1342 www.nature.com/articles/s41586 www.bbc.co.uk/news/world www.nasa.gov/missions/artemis docs.python.org/3/library/re.html stackoverflow.com/questions/11227809 www.who.int/health-topics/malaria
www.britannica.com/topic/printing plato.stanford.edu/entries/kant www.sussex.ac.uk/study/undergraduate www.middlesex.gov/departments/parks arxiv.org/abs/1706.03762 www.ox.ac.uk/about/history www.mit.edu/education www.theguardian.com/science/2021/may
www.lemonde.fr/planete/article/2022 www.spiegel.de/wissenschaft/natur elpais.com/cultura/libros www.repubblica.it/ambiente www.smithsonianmag.com/history www.nps.gov/yell/planyourvisit www.loc.gov/collections/maps europa.eu/youth/learn
www.london.gov.uk/transport data.gov.sg/datasets www.bundestag.de/ausschuesse www.service-public.fr/particuliers www.cdc.gov/flu/treatment www.nhs.uk/conditions/asthma www.mayoclinic.org/symptoms/fatigue pubmed.ncbi.nlm.nih.gov/19872477 www.cancer.org/research
www.boots.com/opticians pharmacy.ucsf.edu/programs www.pharmacytimes.com/news/vaccines www.royalpharmacy-society.org/guides www.metoffice.gov.uk/weather/learn www.weather.com/forecast/today openstreetmap.org/way/4305 www.rivertrust.org/blog/otters
github.com/apache/spark/issues/9 spark.apache.org/docs/latest/sql developer.mozilla.org/en-US/docs/Web www.kernel.org/doc/html www.postgresql.org/docs/current/indexes rust-lang.org/learn www.debian.org/releases/stable wiki.archlinux.org/title/Network
www.allrecipes.com/recipe/16354 smittenkitchen.com/2014/lentil-soup www.kingarthurbaking.com/recipes/bread chefkoch.de/rezepte/apfelkuchen marmiton.org/recettes/quiche www.gardenersworld.com/plants/roses orchardsandvines.com/pruning beekeeping-society.org/hives
www.nationalgeographic.com/animals/mammals ebird.org/species/barswa www.rspb.org.uk/birds www.trails-alpine.ch/huts/12 hikingtheandes.com/routes/peru www.runnersworld.com/training/marathon athletics.org.au/results/track fieldhockey.ca/rules www.fifa.com/tournaments
www.chess.com/lessons/openings boardgamegeek.com/boardgame/13 www.bridgeclub-leeds.org/calendar musicbrainz.org/artist/a74b classical-notes.net/reviews/bach www.metmuseum.org/art/collection www.louvre.fr/expositions www.tate.org.uk/artists poetryfoundation.org/poems/44272
www.classicfm.com/composers theatre-royal.co.uk/whats-on www.opera-bastille.fr/saison filmschool.edu/courses/editing www.criterion.com/films/158 janeausten.co.uk/letters www.glassblowing-guild.org/about assessment.collegeboard.org/scores
www.bankofengland.co.uk/statistics www.ecb.europa.eu/press www.imf.org/publications www.consumerfinance.gov/learn mortgage-advice.org.uk/first-home www.creditunion-dublin.ie/savings money.guide-for-students.edu/budget www.investopedia.com/terms/b/bond
www.paypal.com/us/business support.apple.com/en-us/HT201232 accounts.google.com/help www.microsoft.com/security/blog www.amazon.com/books www.etsy.com/shop/woodcraft www.ikea.com/se/sv shop.lego.com/trains www.patagonia.com/stories
greenwich-village-news.org/2020/04 littleharbourschool.ie/calendar saint-marys-primary.sch.uk/parents publiclibrary-boise.org/events city-orchestra.at/konzerte www.fishermans-coop.no/priser www.mountain-rescue.scot/contact farmersmarket-eugene.org/vendors
blog.annaswoodshop.com/chairs diary.oldsailor.net/2009/07 photos.kitehill.de/album/4 notes.mathswithmolly.org/fractions travel.bluebicycle.nl/norway thequietgardener.net/tomatoes www.adaptivesystems.eu/papers/3 admissions.yale.edu/apply adelaide.edu.au/research
www.advertisingarchives.co.uk/posters betterhomes-repair.com/roofs www.betterworldbooks.com/used alphabet-learning.org/letters tibet-museum.org/objects diabetes.org.uk/guide-to-diabetes www.winchester-cathedral.org.uk/visit windpower-monthly.com/turbines freedomhouse.org/countries
tinywoodenboats.com/plans/dinghy learnknots.net/bowline thesourdoughschool.com/flour mapsofearlytimes.net/atlas/2 oldradiosets.info/valves/el84 citybirdwatch.net/swifts threadandneedle.com/hems storiesfromthesea.net/1911 handmadepaper.info/fibres smallfarmfuture.net/soil
learntheharp.com/lesson/3 mountainhuts.info/tatra vintagetypewriters.net/repair stonewalling.com/courses nightskyguide.net/orion wildmushroomwalks.com/october rainharvest.info/tanks communitychoirs.net/songs thriftyquilts.com/patterns ancientcoins.biz/denarius
www.cambridge.org/core/journals academic.oup.com/mind jstor.org/stable/2183914 www.royalsociety.org/fellows zooniverse.org/projects/galaxy worldoceans.org/reefs polarstation.aq/logbook/17 meteorites.wustl.edu/lunar opencourse.delft.nl/hydrology
""".split()

BUCKETS = 1 << 14
#: Characters of an n-gram.
LENGTHS = (3, 4, 5)
#: N-grams that count in full; those of a longer part count less, so that the length of a path decides nothing.
FULL = 100
#: Top-level domains that anyone may register under, and a beginning that any host may have: they say nothing about it.
_GENERIC = re.compile(r"^www\.|\.(?:com|net|org|info|biz)$")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def features(part: str, kind: str) -> np.ndarray:
    """Buckets of the character n-grams of a host, without what any may have, or of a path; digits count as 0."""
    part = _GENERIC.sub("", part) if kind == "h" else part
    part = f"{kind}^{re.sub(r'[0-9]+', '0', part.lower())}$"
    return np.array([zlib.crc32(part[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in LENGTHS for i in range(len(part) - n + 1)], np.int64)


def scale(n: int) -> float:
    return max(1.0, (n / FULL) ** 0.5)


def vector(host: str, path: str) -> np.ndarray:
    x = np.zeros(BUCKETS)
    for part, kind in ((host, "h"), (path, "p")):
        f = features(part, kind) if part else np.zeros(0, np.int64)
        if len(f):
            x += np.bincount(f, minlength=BUCKETS) / scale(len(f))
    return x


def train(blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, rounds: int = 300, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the labelled table; the same on every call."""
    rows = [(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed]
    x = np.stack([vector(u.partition("/")[0], "/" + u.partition("/")[2]) for u, _ in rows])
    y, w, b = np.array([v for _, v in rows]), np.zeros(BUCKETS), -1.0
    alike = np.where(y > 0, len(allowed) / len(blocked), 1.0)  # the classes count alike, however many rows they have
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * alike
        w -= rate * (x.T @ g / len(y) + decay * w)
        b -= rate * g.mean()
    return w, b


class Model:
    """A URL's log odds are the bias, its host's share and its path's; shares are remembered."""

    def __init__(self, weights: np.ndarray, bias: float, remembered: int = 200_000) -> None:
        self.weights, self.bias, self.known, self.remembered = weights, bias, {}, remembered

    def share(self, part: str, kind: str) -> float:
        if not part:
            return 0.0
        part = re.sub(r"[0-9]+", "0", part)
        if (key := (kind, part)) not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            f = features(part, kind)
            self.known[key] = float(self.weights[f].sum() / scale(len(f))) if len(f) else 0.0
        return self.known[key]

    def score(self, host: str, path: str) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.share(host, "h") + self.share(path, "p")))))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, score, verdict.

    A rule's verdict goes before the model's, which blocks from a score of 0.5. Null urls and those
    without ``://`` have an empty host and path, no rule, and the verdict that the model's bias
    gives, allow. Of rules of one length the first in the list wins. Null page_ids and repeated rows
    pass through; an empty table gives no rows; further columns are not read.
    """
    found = Model(*(model or train()))

    @F.arrow_udf("double")
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([found.score(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)], pa.float64())

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    rows = rows.withColumns({"rule": rule, "ruled": ruled, "score": score("host", "path")})
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
