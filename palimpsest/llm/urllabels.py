"""The small labelled URL table: one line for each site, `host path path ...`.

The wanted sites are well-known reference, news, science, government, teaching, software and culture sites with
paths as such sites have them. The unwanted ones are made-up hosts and paths of the kinds that block lists have:
adult, gambling, pills, loans, counterfeit, cracked software, phishing, advertising and link spam.
"""

from __future__ import annotations

import re

WANTED = """
en.wikipedia.org /wiki/Photosynthesis /wiki/History_of_mathematics /w/index.php
fr.wikipedia.org /wiki/Rivi%C3%A8re /wiki/Paris
de.wikipedia.org /wiki/Geschichte /wiki/Berlin
es.wikipedia.org /wiki/Historia_de_la_ciencia /
www.britannica.com /science/plate-tectonics /biography/Ada-Lovelace
www.bbc.co.uk /news/science-environment-56837908 /sport/football/results /
www.theguardian.com /world/2021/jun/14/election-results /books/review /
www.nytimes.com /2020/03/11/health/coronavirus.html /section/technology
www.reuters.com /world/europe/summit-begins-2022-06-23/ /markets
www.lemonde.fr /planete/article/2021/09/01/climat_6093005_3244.html /
www.spiegel.de /wissenschaft/mensch/a-1234.html /politik/
elpais.com /ciencia/2020-05-20/una-vacuna.html /
www.theatlantic.com /magazine/archive/2019/05/essay/ /ideas
www.economist.com /leaders/2021/07/17/the-world-economy /
www.nature.com /articles/s41586-020-2649-2 /nature/volumes
www.science.org /doi/10.1126/science.abc123 /journal/science
arxiv.org /abs/1706.03762 /list/cs.CL/recent
pubmed.ncbi.nlm.nih.gov /31986264/ /
www.nih.gov /health-information/nutrition /news-events
www.nasa.gov /missions/webb/telescope /image-article/earth
www.noaa.gov /weather /climate/monitoring
www.usgs.gov /programs/earthquake-hazards /
www.cdc.gov /flu/prevention/index.html /
www.who.int /news-room/fact-sheets/detail/malaria /
www.gov.uk /browse/driving /guidance/register-to-vote
europa.eu /european-union/index_en /
www.un.org /en/about-us /sustainabledevelopment/
www.loc.gov /collections/maps /item/2021669100/
www.archives.gov /research/military /
www.parliament.uk /business/publications /
www.ox.ac.uk /admissions/undergraduate /research
www.mit.edu /education/ /research/
web.stanford.edu /class/cs224n/ /~jurafsky/slp3/
www.harvard.edu /academics/ /
ocw.mit.edu /courses/mathematics/linear-algebra/ /
www.khanacademy.org /math/algebra /science/biology
www.coursera.org /learn/machine-learning /
www.gutenberg.org /ebooks/1342 /files/11/11-h/11-h.htm
archive.org /details/texts /about/
plato.stanford.edu /entries/kant/ /contents.html
mathworld.wolfram.com /PrimeNumber.html /
docs.python.org /3/library/itertools.html /3/tutorial/
developer.mozilla.org /en-US/docs/Web/HTML/Element/a /
github.com /torvalds/linux/blob/master/README /apache/spark
stackoverflow.com /questions/11227809/why-is-sorted-faster /
spark.apache.org /docs/latest/sql-programming-guide.html /
www.postgresql.org /docs/current/indexes.html /
kernel.org /doc/html/latest/ /
www.gnu.org /software/emacs/manual/ /licenses/gpl-3.0.html
www.w3.org /TR/html52/ /standards/
www.ietf.org /rfc/rfc2616.txt /about/
www.smithsonianmag.com /history/the-lighthouse-180970000/ /
www.nationalgeographic.com /animals/mammals/facts/otter /
www.metmuseum.org /art/collection/search/437980 /
www.louvre.fr /en/explore/the-palace /
www.tate.org.uk /art/artists/joseph-turner /
www.royalsociety.org /journals/ /
www.theatre.org.uk /whats-on/hamlet /tickets
www.weather.com /weather/tenday/london /
www.metoffice.gov.uk /weather/forecast /
www.allrecipes.com /recipe/16354/easy-meatloaf/ /
www.seriouseats.com /bread-baking-basics-7098 /
www.rhs.org.uk /plants/roses/growing-guide /
www.healthline.com /nutrition/foods-high-in-iron /
www.mayoclinic.org /diseases-conditions/asthma/symptoms-causes/syc-20369653 /
www.lonelyplanet.com /portugal/lisbon /
www.openstreetmap.org /relation/62422 /about
www.nobelprize.org /prizes/physics/1921/einstein/facts/ /
chess.org.uk /clubs/northern-league /results
riverstrust.org.uk /water-quality/report /about-us
countylibrary.org /catalogue/new-books /opening-hours
hillsideschool.edu /curriculum/history /parents
localcouncil.gov.uk /planning/applications /bins-and-recycling
birdwatching.net /species/kingfisher /forum/thread/204
hikingclub.org /trails/north-ridge /en/about
gardeners.net /vegetables/tomatoes.html /news/44
orchestra.org /season/programme /fr/concerts/12
astronomy.net /articles/the-outer-planets /de/artikel/77
www.cam.ac.uk /research/news /study-at-cambridge
www.ed.ac.uk /history-classics-archaeology /library
www.princeton.edu /academics/library /news/2020/05/research
www.berkeley.edu /research/science /
www.ethz.ch /en/research.html /
www.sorbonne-universite.fr /en/research /
www.nationalarchives.gov.uk /education/history /records
www.bl.uk /collections/maps /events
www.britishmuseum.org /collection/object/history /visit
www.sciencemuseum.org.uk /objects-and-stories/medicine /
www.nhm.ac.uk /discover/dinosaurs.html /
www.si.edu /museums/natural-history /research
www.nsf.gov /news/science /funding
www.energy.gov /science/research /
www.epa.gov /water/quality /air
www.nps.gov /yell/planyourvisit/trails.htm /history
www.weather.gov /forecast/rivers /
www.census.gov /library/publications /data
www.bls.gov /news.release/history.htm /
www.ons.gov.uk /economy/reports /census
data.worldbank.org /country/portugal /indicator
www.oecd.org /education/report /
www.imf.org /en/Publications/research /
www.ieee.org /publications/journals /conferences
dl.acm.org /doi/10.1145/3292500 /journals
link.springer.com /article/10.1007/s00134 /journal/10
www.sciencedirect.com /science/article/pii/S0092 /journal/cell
www.jstor.org /stable/2709571 /journal/history
www.pnas.org /content/117/1/article /
www.cell.com /journal/article/fulltext /
www.ncbi.nlm.nih.gov /books/NBK21054/ /pmc/articles/PMC12345/
www.medlineplus.gov /ency/article/000195.htm /
www.nhs.uk /conditions/asthma/treatment /medicines
news.ycombinator.com /item /news
docs.oracle.com /javase/tutorial/essential/ /
learn.microsoft.com /en-us/dotnet/csharp/ /docs
docs.djangoproject.com /en/4.2/topics/db/ /
numpy.org /doc/stable/reference/ /news
pandas.pydata.org /docs/user_guide/merging.html /
readthedocs.org /projects/requests/ /docs
wiki.archlinux.org /title/Network_configuration /
wiki.debian.org /DebianInstaller /News
www.npr.org /sections/science/2021/ /music
www.pbs.org /wgbh/nova/article/history /newshour
www.abc.net.au /news/science/2022-01-04/ /
www.cbc.ca /news/canada/article /radio
www.dw.com /en/science/s-12526 /de/nachrichten
www.irishtimes.com /news/ireland/council /culture/books
www.scotsman.com /arts-and-culture/theatre /news
www.publiclibrary.org /events/children /catalogue
www.villageschool.org.uk /curriculum/science /news/letters
www.towncouncil.gov.uk /meetings/minutes /parks
www.historymuseum.net /exhibitions/maritime /visit
www.sciencejournal.net /article/12/ /archive/2019
www.universitypress.org /books/philosophy /journals
www.folkmusicsociety.org /archive/songs /about
www.riverwalks.net /routes/north.html /map
www.weatherstation.net /readings/today /en/archive/12
www.localhistory.org.uk /articles/mills.html /members
www.healthinstitute.org /research/nutrition /news/44
historians.org /journal/medieval-trade /es/archivo/31
thornton-museum.org /visit /collection/maps.html
"""

UNWANTED = """
adult-video-clips /watch/free/18 /xxx/top-rated
hot-singles-tonight /meet/local /signup
xxx-cams-live /free/girls /en/rooms/3
adult-dating-now /join/free /fr/12
sexy-webcam-chat /live/room /
free-porn-tube /videos/hd /de/cat/5
nude-celebs-leaked /gallery/top /
adultfriendmatch /profiles/hot /
erotic-massage-city /book /prices
escort-girls-vip /city/london /
online-casino-bonus /no-deposit/spins /casino/welcome-bonus
lucky-slots-777 /play/free-spins /en/slots
free-poker-chips /download/now /
sports-betting-tips /odds/win-today /bet
jackpot-city-slots /claim/bonus /
best-roulette-system /win-every-time /
mega-casino-royal /register/bonus200 /es/7
bet-and-win-fast /live-betting /
crypto-casino-dice /faucet/claim /
bingo-big-win /free-tickets /
cheap-pills-online /buy/viagra /order/no-prescription
viagra-cialis-discount /buy-now /cheap
online-pharmacy-usa /order/xanax /
weight-loss-miracle-pills /lose-30-pounds /order
buy-steroids-online /shop/anabolic /cart
male-enhancement-pills /free-trial /
hair-regrowth-miracle /before-after /
keto-diet-pills-shark /special-offer /
payday-loans-instant /apply/now /bad-credit
quick-cash-loans /approved/today /
credit-repair-fast /free-quote /
crypto-doubler-invest /deposit/btc /double
forex-robot-profit /start/earning /
make-money-from-home /secret-system /
get-rich-bitcoin /join/invest /
win-free-iphone /claim/prize /survey
you-won-prize /congratulations/claim /
free-gift-cards-now /generator/amazon /
replica-watches-store /rolex/cheap /buy
fake-designer-bags /louis-vuitton/outlet /
cheap-jerseys-wholesale /nfl/sale /
discount-sunglasses-outlet /ray-ban/90-off /
torrent-cracks-download /full-version/keygen /crack
warez-serial-keys /windows/activator /
free-movie-streams /watch-online/hd /
mp3-download-free /albums/full /
game-hacks-cheats /generator/unlimited-coins /
paypa1-secure-login /verify/account /signin
bank-account-update /login/confirm /secure
apple-id-verify /webscr/login.php /
netfl1x-billing-update /account/payment /
secure-login-verify /confirm/password /
tax-refund-claim /form/submit /
ad-click-tracker /click?id=1 /pixel/track
popup-ads-network /serve/banner /
pay-per-click-cash /earn/clicks /
traffic-exchange-bot /autosurf /
buy-followers-likes /instagram/10000 /order
cheap-backlinks-seo /buy/links /packages
link-farm-directory /submit/url /
spam-email-blaster /bulk/lists /
article-spinner-seo /rewrite/free /
domain-parking-ads /sale /
click-here-now-win /spin/wheel /
registry-cleaner-free /scan/now /download.exe
pc-virus-alert-fix /call/support /warning
toolbar-download-free /install.exe /
psychic-love-spells /free-reading /
essay-writing-cheap /order/paper /
mail-order-brides-russia /catalog /
free-adult-videos /watch/hd /top
adult-chat-live /rooms/free /join
hot-girls-cams /live/now /free
live-sex-shows /watch/free /
xxx-movies-tube /videos/new /hd
porn-videos-free /categories /watch
sexy-singles-dating /signup/free /
casual-hookup-dating /join/now /local
online-poker-bonus /play/free /claim
casino-free-spins /bonus/welcome /slots
vegas-slots-casino /play/jackpot /
sports-bets-online /odds/live /bonus
free-bets-bonus /claim/now /betting
win-jackpot-slots /spin/free /
blackjack-casino-live /play/now /
lottery-winner-claim /prize/claim /win
buy-viagra-cheap /order/online /pills
cheap-meds-pharmacy /buy/pills /no-prescription
online-pills-store /order/now /cheap
diet-pills-cheap /buy/now /free-trial
pharmacy-discount-pills /order/cialis /
fast-weight-loss-pills /order/now /miracle
cheap-loans-online /apply/fast /approved
instant-cash-advance /apply/now /
quick-payday-cash /loan/apply /
bad-credit-loans-fast /apply/today /
bitcoin-profit-robot /invest/now /deposit
crypto-earn-fast /invest/double /join
easy-money-online /earn/daily /secret
earn-cash-clicks /join/free /bonus
cheap-replica-watches /buy/rolex /sale
fake-rolex-store /cheap/watches /buy
replica-bags-outlet /buy/cheap /sale
wholesale-outlet-cheap /buy/nike /discount
crack-software-free /download/keygen /serial
free-keygen-download /crack/full /activator
torrent-movies-free /download/hd /full
warez-download-full /crack/serial /
free-download-crack /setup.exe /full
verify-account-login /secure/update /signin
secure-bank-verify /login/account /update
account-login-confirm /verify/password /webscr
update-billing-verify /account/secure /login
password-reset-secure /verify/now /login.php
free-prize-winner /claim/now /survey
win-gift-card-free /claim/survey /
click-win-prizes /spin/free /claim
ads-banner-click /serve/popup /track
pop-ads-clicks /banner/serve /click
track-ads-pixel /click/redirect /
buy-cheap-traffic /order/clicks /seo
seo-links-cheap /buy/backlinks /order
spam-links-farm /submit/links /
buy-instagram-followers /order/likes /cheap
cheap-followers-likes /buy/now /
bulk-email-spam /lists/buy /send
free-virus-scan-now /download.exe /alert
pc-cleaner-download /free/scan /setup.exe
miracle-cure-pills /order/now /free
love-spells-psychic /free/reading /order
"""


def labelled() -> list[tuple[str, int]]:
    """(url, label), 1 for unwanted. The unwanted names get www. and the endings of the wanted hosts in turn, so that neither tells the classes apart."""
    out: list[tuple[str, int]] = []
    hosts = [line.split()[0] for line in WANTED.strip().splitlines()]
    dressed = [("www." * h.startswith("www."), re.sub(r"^.*?(\.(ac|co|gov|org)?\.?[a-z]+)$", r"\1", h)) for h in hosts]
    for line in WANTED.strip().splitlines():
        host, *paths = line.split()
        out += [(f"https://{host}{p}", 0) for p in paths]
    for k, line in enumerate(UNWANTED.strip().splitlines()):
        name, *paths = line.split()
        www, ending = dressed[k % len(dressed)]
        out += [(f"https://{www}{name}{ending}{p}", 1) for p in paths]
    return out
