import pytest

from strandline.llm import moderation as md

CASES = {
    "abusive": ["What kind of moron are you?", "Shut up, clown, and crawl back to where you came from.", "I'll find out where you live and make you sorry.", "Eres un imbécil, cierra la boca y lárgate.", "You worthless piece of trash, do the world a favour and quit.", "Du rat, halt die Klappe und lass die Finger von der Tastatur."],
    "hateful": ["Typical foreigners: too stupid to think, they belong in a cage.", "I hate gay people, all of them deserve what they get.", "Why hire women? They steal, they lie and they breed like rats.", "Old people are vermin and should be thrown out of this project."],
    "sexual": ["Send me your nudes tonight, I am so horny.", "Hot porn videos here, hardcore and uncensored, adults only.", "She undressed slowly and they had sex on the desk for hours."],
}
NEUTRAL = [
    "The code of conduct forbids harassment, sexual or otherwise, and hate speech of any kind.", "This race between two workers is a bitch, one of them always loses.", "This ugly hack is idiot-proof, but a pig to maintain.",
    "The women in tech meetup discussed the debounce and hired two immigrants' mentors.", "The filter removes adult content and explicit lyrics before the batch is merged.", "Kill the parent process first, then reap the child.",
    "The form asks for sex, age and country; all three are optional.", "The parser chokes on garbage and blows up.", "My stupid mistake: I hit the dead dependency and the job died a slow death.", "Only a fool would trust the clock, as the old saying goes.",
    "Hate to say it, but the cache sucks up all memory and makes me sick.", "Nobody should strip the debug symbols of a naked build.", "", "   ", None, "***", "1 2 3",
]


def found(text):
    _, _, most = md.score(text)
    return {c for c in md.CATEGORIES if most[c] >= md.THRESHOLD}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in CASES.items() for t in ts])
def test_cases(kind, text):
    assert found(text) == {kind}
    assert found(text.upper()) == {kind}
    assert found("The batch is merged.\n\n> PS: " + text + "\n" + "Nothing else happens here. " * 200) == {kind}


@pytest.mark.parametrize("text", NEUTRAL)
def test_neutral(text):
    assert found(text) == set()


@pytest.mark.parametrize("said", ["m0r0n", "m*ron", "m***n", "mo​ron", "m o r o n", "m.o.r.o.n", "mоrоn", "moooron", "MoRoN", "móron", "m-o-r-o-n"])
def test_disguises(said):
    assert found(f"What kind of {said} are you?") == {"abusive"}


#: Texts made up after the lexicon, none of them from any table.
FRESH = {
    "abusive": ["you absolute nincompoop", "I will stab you tonight", "I'm going to break your legs if you merge this.", "Kill yourself, nobody would miss you.", "You are pathetic and your code is too.", "Go f*** yourself, you w****r.", "Somebody should strangle you.", "Du bist ein Arschloch.", "Ta gueule, connard!", "U r an idi0t", "Shut your mouth, you weasel."],
    "hateful": ["All Finns are thieving animals", "Jews are vermin.", "Deport all immigrants, they are criminals.", "Muslims should not be allowed here, they are savages.", "We hate Mexicans and they should be shot.", "Women are inferior and belong in the kitchen.", "Romanians: liars and thieves, every single one of them.", "Get rid of them, those refugees are parasites."],
    "sexual": ["She moaned while he caressed her breasts.", "Looking for casual sex tonight?", "Free porn, hot milf videos.", "I want you naked in my bed tonight.", "He unzipped and she gave him a blowjob."],
}
FRESH_NEUTRAL = [
    "If you kill the worker, the queue drains.", "Don't let the name fool you: this is a cache.", "You can beat the baseline with a larger batch.", "A rat in the maze benchmark is an agent, you can configure it.", "This will cut your bill in half.",
    "The disabled flag hides dirty rows.", "Women and men were surveyed equally; all of them answered.", "The sex column holds m or f.", "Hot paths are inlined; explicit is better than implicit.", "German and French people use different separators.",
    "His liver disease was treated; the plague of 1665 killed many in London.", "I hate merge conflicts and typical off-by-one errors.", "You killed the build again.", "The breast cancer data set has 569 rows.", "The clown fish uses you as an example.",
]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in FRESH.items() for t in ts])
def test_fresh_cases(kind, text):
    assert found(text) == {kind}


@pytest.mark.parametrize("text", FRESH_NEUTRAL)
def test_fresh_neutral(text):
    assert found(text) == set()


def test_any_number_of_words_with_stars():
    assert found("Sh** up, you m***n, cr*wl b*ck to wh*re you c*me fr*m, you p**hetic sc**bag, *and* take your g*rb*ge and your tr*sh with you") == {"abusive"}
    assert found("what a **moron** you are") == found("t**t like you") | {"abusive"} == {"abusive"}
    assert found("s*** f*** b*** c*** d*** e*** g*** h*** i*** k*** l*** m*** " * 50) <= set(md.CATEGORIES)


def test_weights_are_normalised_by_length():
    """What adds up to a case in a sentence does not if it is strewn over a long one; a case within a long one stays."""
    filler = "the cache is merged and the queue is drained before the index is built again " * 6
    assert found("trash garbage damn crap") == {"abusive"} and found(f"trash {filler} garbage {filler} damn {filler} crap") == set()
    assert found(f"{filler} what kind of moron are you {filler}") == {"abusive"}


def test_score_is_by_length(spark):
    short, long = "You disgust me.", "You disgust me. " + "The merge is fine here. " * 50
    rows = [(1, short, "s", "x"), (2, long, "s", "x"), (3, None, None, "x"), (4, "", "t", "x"), (1, short, "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, category string")
    scored = md.score_documents(df, keep=("source",))
    by = {r.doc_id: r for r in scored.collect()}
    assert by[1].abusive > by[2].abusive > 0 and by[1].is_abusive and by[2].is_abusive
    assert by[3].n_words == by[4].n_words == 0 and not by[3].is_abusive
    assert sorted((r.doc_id, r.category) for r in md.cases(scored).collect()) == [(1, "abusive"), (1, "abusive"), (2, "abusive")]
    rate = {r.source: (r.documents, r.abusive_rate, r.any_rate) for r in md.rates(scored).collect()}
    assert rate == {"s": (3, 1.0, 1.0), None: (1, 0.0, 0.0), "t": (1, 0.0, 0.0)}
    assert md.score_documents(df.where("false")).count() == 0
