"""Terms of abuse, demeaning language and sexual content in English, Italian and German, and how they are aimed.

They are here to be found and kept out of training text. Terms are written without accents and in lower case. A pattern is a course of
words in one stretch: `a|b` either word, `@name` any word of a named list, `3:` before a word that up to three others may precede.
"""

# Words for a person.
INSULTS = """
idiot moron cretin imbecile halfwit dimwit dumbass asshole bastard prick dickhead jackass shithead scumbag twat wanker douchebag loser
fuckwit motherfucker bitch cunt arsehole tosser dipshit nitwit simpleton coward whore slut
idiota cretino cretina imbecille deficiente stronzo stronza coglione bastardo bastarda carogna bestia stupido scemo pirla cazzone puttana
arschloch wichser trottel vollidiot mistkerl versager sau schwein depp hurensohn dummkopf drecksack penner schlampe
""".split()
# Words that insult whoever is said to be one.
REFUSE = "garbage trash rubbish dirt nothing merda spazzatura rifiuto mull dreck nichts".split()
# Words that worsen such a word, or insult whoever is said to be so.
SLURS = """
worthless spineless brainless pathetic disgusting fucking goddamn stupid useless filthy ugly dumb clueless
inutile schifoso schifosa patetico ridicolo ridicola
dreckiger dreckige dreckiges blode bloder dumm dumme dummer verdammter widerlich erbarmlich nutzlos
""".split()
# Words by which a person is meant.
YOU = "you your yourself yours youre du dich dir dein deine deinen deiner euch sei ti te tuo tua tuoi tue voi vi".split()
PERSON = """
whoever listen he she him her man woman guy boss operator colleague girl boy
chi lui lei uomo donna capo collega
wer er ihm ihn mann frau chef kollege ihr
""".split()
BODY = "face neck head skull legs arms bones teeth throat jaw fingers mouth knees faccia testa gambe ossa denti gola fresse schadel knochen zahne genick kopf hals".split()
VIOLENCE = """
kill killed murder murdered strangle strangled stab stabbed beat smash break cut slit punch burn burned choke drown drowned shoot shot crush bash
""".split()
INTENT = "i ill we well gonna hope wish should somebody someone lets let".split()

# Each of these threatens, or degrades whom it is said to.
THREATS = [
    "@INTENT 6:@VIOLENCE you", "@INTENT 6:@VIOLENCE your 1:@BODY", "@VIOLENCE yourself", "hang yourself", "drop|dropped|fall dead", "screw|fuck yourself", "fuck you",
    "shut your 2:mouth|trap|face", "hope you die|rot|choke|suffer", "spit|spat|piss on 1:you|him|her|man|woman", "nobody|noone likes|loves|wants|needs you", "you should|deserve 2:die|rot",
    "ti spacco|rompo|spezzo 1:faccia|testa|gambe|ossa", "ti ammazzo|uccido|strozzo|massacro", "fatti|farti fottere|friggere", "fai schifo", "buono|buona a nulla", "vaffanculo", "devi morire|crepare",
    "halt 1:fresse|maul|klappe", "verpiss dich", "fick dich", "bring|bringe dich 1:um", "mach|mache dich fertig|kalt", "schlag|schlage|brech|breche dir 2:@BODY", "du sollst 2:sterben|verrecken",
]

GROUPS = """
women immigrants foreigners migrants refugees cripples southerners northerners gypsies jews muslims christians hindus blacks whites asians
africans arabs turks poles mexicans gays lesbians homosexuals natives
donne stranieri immigrati migranti profughi zingari ebrei musulmani negri africani arabi meridionali disabili anziani omosessuali
frauen auslander zugezogene zuwanderer fluchtlinge migranten zigeuner juden muslime schwarze behinderte turken polen schwule
""".split()
# With the word before them these name a group.
PEOPLE = "people folk folks families tribes kind leute gente famiglie popolo volk".split()
# How the name of a people ends, where it isn't listed.
PEOPLES = r"(?:..(?:ians|eans|anesi|iani|ier|aner)|...ani|...esi)$"
# Said of many, each of these demeans them.
DEMEANING = """
rats vermin filth parasites animals savages subhuman disease thieves scum inferior pigs cockroaches criminals monkeys
bestie parassiti feccia inferiori stupide stupidi ladri topi subumani criminali scimmie animali
abschaum ungeziefer parasiten untermenschen ratten minderwertig diebe verbrecher tiere dreck
""".split()
# Of these even an unlisted people is only said where it is meant.
# What is said of unlisted peoples too; the rest is said of things as well.
HARSH = """
rats vermin filth parasites animals savages subhuman disease thieves scum pigs cockroaches
bestie parassiti feccia ladri topi subumani
abschaum ungeziefer parasiten untermenschen ratten diebe
""".split()
CREATURES = "cani gatti dogs cats wolves hunde katzen vogel tiere rats mice pigeons ants bugs cockroaches weeds topi piccioni formiche ratten mause tauben ameisen".split()
# Of one person.
IS = "is was isnt ist war e era".split()
# Written with a capital at the start of sentences and headings, and no people.
COMMON = "this these those there here when then where while since always others yes please warning warnings notes rules tests files users values diese hier wenn wer alle questi queste tutti note".split()
COPULA = "are were all sono erano sind waren alle like".split()
# Each of these, said of a group, demeans it or wishes it harm.
HARM = [
    "belong|belongs in|behind chains|cages|bars|camps|ovens|jail|prison", "back|home 1:where 1:came|come|belong", "get|getting rid of 1:@GROUPS", "get rid of all", "breed|breeding|multiply 1:like 1:@DEMEANING",
    "should|must|ought 2:exterminated|deported|gassed|banned|shot|hanged|sterilised|expelled|burned|killed|kept|removed|locked", "never|dont trust", "not for 1:@DEMEANING",
    "kind has|have|is|are no|not 1:brains|brain|sense|good|human|place", "born thieves|criminals|liars",
    "vanno|andrebbero|devono 1:cacciati|cacciate|eliminati|rimpatriati|sterminati|bruciati|espulsi", "non capiscono niente|nulla", "tornino|tornare|tornate 1:casa",
    "gehoren|sollten|mussen 2:weggejagt|vergast|abgeschoben|erschossen|eingesperrt|ausgerottet", "zuruck wo|woher 2:kommen|gekommen", "raus aus unserem|diesem land",
]

# Terms that are sexual by themselves, and those that are so only together.
SEXUAL = """
porn porno pornos nudes horny scopato scopare scopata nacktbilder geil blowjob orgasm masturbate masturbating gefickt ficken
""".split()
SUGGESTIVE = """
naked breasts thighs moaning sex sesso nuda nackt uncensored xxx lick undressed erotic nudo nude fucked stripping stohnen bruste
""".split()
ACTS = [
    "having|had|have|having sex", "fatto|fare|facciamo|facevano sesso", "hatten|haben 2:sex", "undressed|undress|strip|lick|fucked|fuck her|him|me|you", "kissed|kiss|lick 1:bare|naked 1:breasts|thighs|body",
    "naked and moaning", "voglia di te", "senza niente addosso", "foto|photo|photos|pics|bilder 3:nuda|nudo|naked|nude|nackt|porno|vestiti", "body between thighs", "between 1:thighs", "naked|nude|nuda 1:photo|photos|pics|picture|pictures|foto|bilder", "xxx scene|video|clips|movie", "senza vestiti",
]
# A wish for such content, or the parts of one, that an insult is not.
ASKED = "foto photo photos pics bilder mandami schick send".split()

# Of what is merely quoted, ruled out, or said of oneself.
DISTANCE = """
rules rule policy quote quoted quotes forbidden prohibited insulting harassing harassment reported complaint moderation
regole regola vietato segnalato insulti
regeln regel verboten beleidigung beleidigungen gemeldet
""".split()
REPORTING = """
say says said saying write writes writing wrote written called call calling reads read word words phrase text manual
dice disse detto scrive scrivere scritto parola frase dire
sagt sagte sagen schrieb schreibt schreiben wort steht satz beispiel
example examples measured scored esempio
""".split()
FORBIDDING = "not never dont no non mai nicht nie niemals kein".split()
SELF = ["i am 4:", "i was 4:", "im 4:", "sono 3:", "ero 3:", "ich bin 4:", "ich war 4:"]
ONESELF = ["my side", "my mistake", "my fault", "myself", "errore mio", "colpa mia", "von mir", "mein fehler"]
YOU_ARE = ["you are 3:", "youre 3:", "you re 3:", "sei 3:", "siete 3:", "du bist 3:", "ihr seid 3:"]
# What a thing is called, in technical language.
TECHNICAL = [
    "bastard file", "bastard cut", "naked eye", "naked flame", "bare wire", "idiot light", "idiot proof", "nude sensor", "cavo nudo", "filo nudo", "occhio nudo", "nackte draht", "nackten draht", "dirt cheap", "strip you of",
]

# Ordinary words within one edit of a term above; they aren't taken for it.
ORDINARY = """
aitch anal animal anker arab arabia arabic asian backt baked banker batch beasts benner beste birch black blade blocks blonde bolder boron botch braten brauen breast brick brute
butch caught christian closer corno corny cowards cretan crick cripple crippled daten denner diseased done ditch ducked dummy duden dudes ebreo efficiente
erratic exotic fifth filch foreigner forno freccia gatten grauen hackt hanker hatten highs hitch idiom immigrant immigrato inferiore interior
jackals jenner kenner lacks laser laten latten lavages lesbian lesser loaning logger loner loose looser lose loses lover lower luden maroon matten meaning menda merca merla
migrant migrante monkey mooning morin mormon morning mucked muslim muslima nacht native negli nenner nodes northerner packt padri parasit parasite
parasitic parassita pender perda pick pinner pirlo pitch porro porto poser price pricks raked rasten rated rater rates rattern refuge refugee renner
rotten rudes sackt salvage salvages savage scappare scappata scappato schein schwarz schwarzen schwarzer schwarzes schweiz shore scolato scovare
southerner straniero stupito sucked tanker taser taten termin there tier thieve thigh thorny toner torno tower trauen trotter tucked verein verlager vermis
versage versagen wander wenner where whole white winker witch woman writes zingaro putting criminal polls poles turkey stripe disabile
""".split()

# Characters of other alphabets that look like Latin letters, and digits that stand for letters.
LOOKALIKES = str.maketrans("авеёзіјкмнорстухѕԁԛԝһαβεικνορτυχ", "abee3ijkmhopctyxsdqwhabeiknoptux")
LEET = str.maketrans("0134578@$", "oieastbas")
