"""Words and phrases of the content lexicon, with weights, in folded form (lower case, no accents, apostrophes as blanks).

A sentence is a case of a category if the weights found in it reach 1. Most entries are single stems; phrases are made of parts by rule
(verb and person, address and adjective, wish and harm) or are common idioms. Words of address, slurs and names of groups weigh
by their company: see moderation.py. The lists name words in order to find them; they express no view.
"""

#: Insulting nouns: half a case by themselves, a whole one with a word of address in the sentence.
SLURS = (
    "moron idiot imbecile cretin nitwit halfwit dimwit dunce dolt dullard simpleton ignoramus nincompoop ninny numbskull numskull blockhead bonehead airhead birdbrain lamebrain pinhead dumbo dummkopf "
    "fool buffoon oaf lout boor twit twerp plonker pillock numpty berk muppet jackass dumbass asshole arsehole asshat asswipe dipshit shithead shitbag dickhead fuckwit fuckface fucker motherfucker "
    "bastard bitch cunt twat prick wanker tosser bellend douche douchebag jerk weirdo psycho lunatic maniac pervert loser failure wimp coward sissy crybaby chump schmuck putz "
    "scum scumbag dirtbag sleazebag lowlife parasite wretch slob slut whore skank hag liar traitor hypocrite retard "
    "imbecil idiota estupido pendejo cabron gilipollas connard abruti salaud cretino stronzo vollidiot arschloch trottel depp wichser schlampe hurensohn nichtsnutz"
).split()

#: Insults that are also harmless words; they need more company.
BEASTS = "pig rat weasel toad maggot cockroach leech swine donkey clown jester creep freak sucker".split()
CALLED = "you,you little,you dirty,you filthy,you fat,you stupid,you old,du,tu,are a,re a,such a,like the,u".split(",")

#: Words that address somebody.
ADDRESS = "you,your,yours,yourself,you re,u,ur,du,dich,dir,dein,deine,tu,te,t es,toi,ton,eres,tus,ti".split(",")

#: Adjectives of contempt; they weigh by themselves and make a case in the address "you are ...".
CONTEMPTUOUS = "pathetic worthless disgusting stupid ugly dumb useless brainless clueless repulsive revolting spineless filthy incompetent miserable hopeless idiotic moronic imbecilic".split()
ADDRESSED = "you are,you re,you,ur,u r,you are so,you re so,you are such a,you are just a,you are nothing but a,what a".split(",")

#: Violence against a person: verb and person. Those of the first list are a case by themselves, the rest with an announcement.
VIOLENT = "kill murder stab shoot strangle behead slaughter rape torture drown bury lynch".split()
ROUGH = "beat punch slap smash crush hurt harm hang poison cut burn choke gut break hunt whip kick knife".split()
PERSON = "you,you up,you down,you all,your face,your head,your skull,your teeth,your nose,your jaw,your neck,your throat,your legs,your knees,your arms,your hands,your fingers,your bones,your family,your kids,your children,your wife,your mother,your house".split(",")
ANNOUNCED = "i ll,i will,i m going to,i am going to,going to,gonna,i swear,we ll,we will,they ll,somebody will,someone will,somebody should,i want to,want to,next time,until you".split(",")
#: Wishes of harm.
WISH = "hope you,hope they,i wish you,wish you would,wish you d,pray you,you should,you deserve to,please".split(",")
HARM = "die,choke,rot,suffer,burn,bleed,get cancer,were dead,never wake up,kill yourself,fire you,crash and burn,drop dead,jump off a bridge,hang yourself".split(",")

#: Shutting a group out: place from which it is kept, thrown or banned.
OUT_OF = "out of the,out of our,out of this,out of my,banned from,banned from the,banned from our,not allowed in,not allowed here,no place in".split(",")
PLACES = "team,country,company,project,office,neighbourhood,neighborhood,city,town,school,schools,army,church,building,room,industry,public".split(",")

#: Names of groups, in the plural or before "people".
GROUPS = (
    "women,woman,girls,men,females,males,immigrants,migrants,refugees,foreigners,asylum seekers,natives,gays,lesbians,bisexuals,homosexuals,queers,gay people,trans people,transgender people,transsexuals,"
    "disabled people,the disabled,disabled,cripples,deaf people,blind people,autistic people,autistics,mentally ill people,old people,the elderly,elderly,elderly people,pensioners,boomers,young people,teenagers,"
    "muslims,jews,christians,hindus,buddhists,sikhs,catholics,protestants,mormons,atheists,believers,nonbelievers,infidels,black people,blacks,white people,whites,brown people,asians,africans,arabs,latinos,hispanics,gypsies,roma people,"
    "americans,mexicans,canadians,brazilians,cubans,poles,polish people,russians,ukrainians,germans,french people,italians,spaniards,greeks,turks,kurds,iranians,iraqis,syrians,afghans,pakistanis,indians,chinese people,the chinese,japanese people,koreans,vietnamese people,"
    "filipinos,nigerians,somalis,ethiopians,egyptians,algerians,moroccans,israelis,palestinians,swedes,finns,danes,norwegians,dutch people,belgians,irish people,the irish,scots,romanians,bulgarians,serbs,croats,albanians,hungarians,czechs,"
    "people from the south,people from the north,people from the east,people from the west,poor people,homeless people,fat people,people like them,people of that"
).split(",")

#: Insults and threats besides those made by rule, by weight.
ABUSIVE = {
    1.0: (
        "you disgust me,you make me sick,piece of shit,fuck you,fuck off,screw you,go to hell,rot in hell,burn in hell,eat shit,kill yourself,hang yourself,drop dead,go die,kys,son of a bitch,go fuck yourself,"
        "nobody likes you,no one likes you,everybody hates you,everyone hates you,nobody wants you,nobody would miss you,nobody ever liked you,waste of space,waste of oxygen,waste of skin,"
        "where you live,know where you sleep,make you regret,make you pay for,you are a dead man,you re a dead man,dead meat,worthless piece of,"
        "eres una,hijo de puta,vete a la mierda,te voy a matar,espece d,espece de,tu ne vaux rien,va te faire,ta gueule,je vais te tuer,halt s maul,halt dein maul,verpiss dich,fick dich,ich bring dich um"
    ),
    0.7: (
        "shut your mouth,shut your face,shut your trap,piss off,bugger off,drop you on,dropped you on,dropped on your head,crawl back,make me want to puke,make me vomit,laughing at you,laughs at you,laugh at you,"
        "life is a joke,you are a joke,you re a joke,go back to where you came from,cierra la boca,callate,nadie te aguanta,nadie te quiere,halt die klappe,degage,casse toi,pauvre type,pauvre con,largate,verschwinde,hau ab"
    ),
    0.6: "watch your back,make you sorry,you will be sorry,you ll be sorry,next time i see you,piece of trash,piece of garbage,piece of crap,piece of filth,make you pay",
    0.5: "half a brain,bird brain,shut up,get lost,go away you,stop whining,stop crying,nobody asked you,do the world a favour,do the world a favor,do us all a favour,do us all a favor,ashamed of yourself,like you could,what kind of,your mother,how dare you,behind your back,vaux rien,nobody ever will,dummer,dumme,blode,mierda,basura",
    0.3: "trash,garbage,disgust,lazy,damn,crap,shit,fucking,bloody",
}

#: Contempt of a group or violence against it, by weight; a group's name in the sentence, or in the one before, adds one half.
HATEFUL = {
    1.0: "inferior race,master race,dirty race,subhuman race,gas them,exterminate them,exterminate all,kill them all,hang them all,wipe them out,ethnic cleansing,breed like rabbits,final solution",
    0.8: "subhuman,subhumans,untermenschen,filthy liars,race of,decent human beings,decent people,cleaner without,better off without,go back to your own,go back to your country,go back to their country,go back where they came from,purge them,get rid of them,ship them back",
    0.7: "belong in a cage,belong in cages,belong in jail,belong in the kitchen,breathe our air,breathe the same air,ruin everything,are vermin,are animals,are savages,are parasites,are a plague,are a disease,are a cancer,are scum,are filth",
    0.6: "they steal they lie,steal and lie,lock them away,lock them up,vermin,savages,barbarians,cockroaches,too stupid to,too dumb to,a plague,a disease,a cancer,deport them,deport all,throw them out,should be shot,should be hanged,should be gassed,should be locked,should be banned,should be deported,should be sterilised,should not be allowed,should never be allowed,must be removed,round them up,burn them",
    0.5: "i hate,we hate,i despise,i can t stand,deserve what they get,deserve to die,deserve to suffer,had it coming,disease,plague,filthy,breed,cage,cages,inferior,own kind,round up,animals,beasts,rats,thieves,criminals,rapists,scum,parasites,uncivilised,uncivilized",
    0.3: "they are all,they re all,every single one of them,each and every one of them,typical,can t help it,all of them,all the same,liars,cheats,thieving,lying,dirty,lazy,stupid,ugly,that kind,those people,these people,ruins everything,ruin everything,steal,smell,stink",
}

#: Sexually explicit or soliciting, by weight.
SEXUAL = {
    1.0: (
        "nudes,had sex,have sex,having sex,casual sex,sex with,hot sex,anal sex,oral sex,blowjob,blow job,handjob,orgasm,orgasms,masturbate,masturbating,masturbated,threesome,gangbang,cum on,cumshot,porn videos,hot porn,free porn,"
        "so horny,lick you,fuck me,into my bed,in my bed tonight,made love,make love to,hot singles,wet pussy,hard cock,sext,sexting,your breasts,your tits,your ass,dick pic,dick pics"
    ),
    0.8: "horny,porn,porno,pornographic,kinky,erotic,touch you all over,see you naked,want you naked,tore off,xxx pics,xxx clips,xxx videos,strip you,strip for me,not wearing anything,penis,vagina,clitoris,pussy,dildo,vibrator,bdsm,fetish,milf",
    0.6: "xxx,breasts,boobs,tits,nipples,take off your clothes,take off that,undress,undressed,undressing,rode her,do it to you,no strings attached,hook up tonight,come and watch me,between his thighs,between her thighs,between her legs,between his legs,aroused,seduce,seduced,sexy,camgirl,escorts,lap dance",
    0.5: "naked,nude,moaned,moaning,thighs,lust,hook up,uncensored,hardcore,nice body,get so turned on,fantasy,fantasies,bedroom,lingerie,panties,thrust,caressed",
    0.4: "sex,adults only,over 18 only,groaned,webcam,escort,all night in,all night long,private show,sweating,in bed",
    0.2: "explicit,adults,adult,kissed,kiss,singles,tonight,hot",
}

#: Technical and neutral uses: what they cover is no sign of anything. Slurs before "proof" are added by rule.
EXCEPTIONS = (
    "hate speech,code of conduct,hate to say,hate to admit,adult content,explicit lyrics,explicit type,explicit cast,be explicit,explicit path,penetration test,penetration tests,trash can,is not trash,the trash,moved to trash,"
    "garbage collection,garbage collector,garbage collected,garbage in,sex age,asks for sex,sexual or otherwise,sexual harassment,sex education,same sex,unisex,race between,race condition,race of two,stupid mistake,ugly hack,"
    "lazy loading,lazy evaluation,lazy queue,lazy load,women in tech,kill the,reap the,dead letter,naked eye,strip the,dirty flag,dirty read,dirty bit,nsfw filter,hardcore mode,webcam driver,round up to,shut up the,"
    "master branch,dummy,fool you,fools you,fooled you,scope creep,feature creep,freak out,rat hole,donkey work,liar paradox,sucker for,poor performance,hot path,hot spot,hot reload,hot swap,hot cache,"
    "won t kill you,will not kill you,not kill you,would it kill you,won t hurt you,doesn t hurt you,not hurt you,to beat you,cut you off,cut you down,burn you later,what kind of error,what kind of test,what kind of data"
).split(",")

#: Words that occur in any text; a phrase is looked for only where one of its other words stands.
COMMON = (
    "a about again air all am an and any anything are as asked at back be been being better between bit body brain by came can case cause city clean cleaner come could country d dare data de did do does doing don down each en error es et "
    "ever every everybody everyone everything face favor favour fingers for from get gets go going good had half has have head her here him his hot how i if in into is it its je joke kind know la like live ll long look m made make makes me mean "
    "mode more mother must my never new next night no nobody not nothing of off on once one only or our out over own path people place please quit race re refuse review s said same say see should show so some somebody someone something "
    "stand still stop t take team te test than that the their them then there these they thing this those time to too top tu turn turned type un up us use used very voy vais wake want was watch way we what when where which while who why will wish with without work world would y you your"
).split()

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("авеікмнорстухѕјԁһԛԝɡıοανερτυικχγ", "abeikmhopctyxsjdhqwgioavepiuikxy", strict=True)) | {"ѵ": "v", "ӏ": "l", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "ʏ": "y", "ʜ": "h", "ɴ": "n"}
#: Digits and signs that stand for letters; 1 and | may also be l, which is tried second.
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
