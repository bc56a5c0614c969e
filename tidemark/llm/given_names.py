"""Given names and their short forms."""

from __future__ import annotations

# Given names with their usual short forms, in alphabetical order.
SHORT_FORMS: dict[str, str] = {
    "alexander": "alex sandy sasha", "amara": "", "andrew": "andy drew", "anthony": "tony", "aoife": "", "benjamin": "ben benny", "bodil": "", "bruno": "", "celeste": "", "charles": "charlie chuck",
    "chidi": "", "christopher": "chris kit", "dagny": "", "daniel": "dan danny", "deborah": "deb debbie", "dimitri": "dima", "dorothy": "dot dolly dottie", "edward": "ed eddie ned ted teddy",
    "eleanor": "ellie nell nora", "elizabeth": "liz betty beth eliza lizzie", "emre": "", "esther": "essie", "farid": "", "femi": "", "francisco": "paco pancho", "frederick": "fred freddie", "friedrich": "fritz",
    "gabriel": "gabe", "gregory": "greg", "greta": "", "guadalupe": "lupe", "gudrun": "", "hana": "", "harold": "hal harry", "heinrich": "heinz", "henrietta": "hettie etta", "hiro": "", "ignacio": "nacho",
    "ines": "", "isabella": "izzy bella", "ivo": "", "jacob": "jake", "james": "jim jimmy jamie", "jelena": "", "johannes": "hannes", "jonathan": "jon jonny", "jorge": "", "josephine": "jo josie",
    "katherine": "kate kathy katie kit", "kenji": "", "kofi": "", "lawrence": "larry", "leila": "", "leonard": "len lenny", "lucia": "", "marek": "", "margaret": "meg peggy maggie", "matilda": "tilly",
    "michael": "mick mike mikey", "milos": "", "nadia": "", "nathaniel": "nat nate", "nicholas": "nick nicky", "noor": "", "oleksandr": "olek sashko", "omar": "", "patricia": "pat trish patty",
    "penelope": "penny nell", "peter": "pete", "philippa": "pip pippa", "priya": "", "quentin": "", "rebecca": "becca becky", "richard": "dick rick richie", "robert": "bob bobby rob", "ronald": "ron ronnie",
    "rosa": "", "samuel": "sam sammy", "soren": "", "stephanie": "steph", "susannah": "sue susie", "tamsin": "", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim", "umberto": "",
    "ursula": "uschi", "valentina": "val tina", "veronica": "ronnie vera", "victoria": "vicky tori", "vincent": "vinny vince", "viola": "", "wanda": "", "william": "will bill billy", "xenia": "",
    "yusuf": "", "zachary": "zack zach", "zelda": "",
}
#: Short forms that are also common words: in lower case they aren't taken for names by themselves.
COMMON_WORDS = frozenset("bill dot drew hal harry jo kit nat ned nell pat penny pip rob sandy sue ted val will chuck etta bella mike rick dan jake dick mick".split())

GIVEN_NAMES = frozenset(SHORT_FORMS) | frozenset(short for forms in SHORT_FORMS.values() for short in forms.split())


def long_forms() -> dict[str, frozenset[str]]:
    """Each given name or short form with the given names it may stand for."""
    out: dict[str, set[str]] = {name: {name} for name in SHORT_FORMS}
    for name, forms in SHORT_FORMS.items():
        for short in forms.split():
            out.setdefault(short, set()).add(name)
    return {k: frozenset(v) for k, v in out.items()}
