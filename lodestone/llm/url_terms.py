"""The default vocabulary of URL terms: words by subject, and the compounds that name a trade."""

from __future__ import annotations

#: Words that say enough by themselves, in several languages.
STRICT_WORDS = (
    "porn porno pornos porns pornstar pornstars pornhub pornographie pornografia xxx xxxvideos hentai milf milfs camgirl camgirls camsex blowjob blowjobs gangbang bukkake handjob creampie cumshot deepthroat bdsm "
    "footjob upskirt voyeurcam sexcam sexcams sextube sexshop sexchat sexvideo sexvideos sexdating fickfilme ficken fotze nackedeweiber sexkontakte putas culonas tetonas porno-gratis videos-xxx plan-cul "
    "viagra cialis levitra kamagra tadalafil sildenafil vardenafil xanax-online tramadol-online oxycontin phentermine escorts escortservice callgirls escort-girls escort-girl huren bordell prostituees "
    "spam-farm link-farm linkfarm warez keygen keygens serialz crackz cracked-software nulled-scripts replica-watches fake-id fakeid fake-passport carding cvv-shop fullz darkweb-market"
).split()

#: Words that say something together with others, with their weights.
SOFT_WORDS = {
    1.5: "adult casino casinos nude nudes poker sex sexy erotic erotica erotik erotique escort naked strip stripper fetish lesbians horny slut sluts tits boobs pussy pokies blackjack roulette nsfw sexo desnudas nackt nue nues",
    1.0: "ads bet bets betting bookmaker bookmakers dating hookup jackpot lottery lotto loans payday pills spam slots slot track tracker wager gambling gamble sportsbook xx pharmacy apotheke farmacia pharmacie steroids torrent torrents "
    "cracked nulled serial crack warezbb replica replicas clickbait popads popunder adserver adclick banners malware phishing exploit keylogger botnet hookups singles swingers cams webcam webcams fling amateur amateurs lingerie "
    "wetten gluecksspiel glucksspiel spielautomaten apuestas tragaperras loteria paris-sportifs machines-a-sous rencontres kredit kredite prestamos credit-rapide",
    0.5: "affiliate affiliates aff bonus bonuses cheap click clicks crypto bitcoin forex farm free freebies gratis gratuit kostenlos win winner winners prize prizes promo promos discount discounts coupon coupons deal deals offer offers "
    "redirect redir popup popups banner traffic seo backlink backlinks viral rich cash money earn income quick fast instant guaranteed unlimited girls hot teen teens babes cam live chat weightloss diet detox keto cbd vape hemp",
}

#: Two words in a row that name a trade: each of the first with each of the second, written as one, with a hyphen, an underscore or a dot.
COMPOUNDS = (
    ("adult free live hot best top hd teen amateur celebrity hidden granny mature asian ebony latina gay tranny shemale lesbian", "porn xxx sexcam camgirls sextube pornvideos hentai nudes cams"),
    ("casino online-casino slot slots poker roulette blackjack jackpot baccarat pokies", "win bonus games spins online real-money no-deposit jackpots vip royal palace"),
    ("free best online top new live mobile bitcoin crypto", "bets casino casinos slots poker-bonus spins betting-bonus roulette pokies jackpots sportsbook"),
    ("cheap buy order online generic discount no-prescription canadian", "pills viagra cialis meds pharmacy xanax tramadol valium ambien adderall steroids hgh modafinil oxycodone"),
    ("payday instant fast quick bad-credit no-credit-check", "loans loan cash-advance cash-loans credit-cards"),
    ("buy cheap get real instant", "followers likes backlinks traffic subscribers reviews-cheap views-cheap"),
    ("replica fake cheap luxury", "rolex watches handbags gucci louboutin designer-bags sunglasses-sale"),
    ("free full latest", "keygen crack-download warez serial-keys nulled cracked-apk modapk-unlimited"),
    ("work-from-home make get earn", "money-fast rich-quick cash-daily easy-money passive-cash"),
    ("adult sex local horny married cheating", "dating hookups hookup affairs meet-n-fuck singles-tonight personals chatroom"),
)
JOINTS = ("", "-", "_", ".")


def strict_terms() -> tuple[str, ...]:
    made = {"adult-x", *STRICT_WORDS}
    for first, second in COMPOUNDS:
        made |= {f"{a}{j}{b}" for a in first.split() for b in second.split() if a != b for j in JOINTS}
    return tuple(sorted(made))


def soft_terms() -> dict[str, float]:
    return {t: w for w, words in SOFT_WORDS.items() for t in words.split()}
