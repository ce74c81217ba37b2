import pytest

from quarrystone.llm.pairs import broken_pairs, defects

Q = "What is the response time of the wall unit?"
ANSWER = "The wall unit settles within ten seconds when it is warmed up."


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        (Q, ANSWER, []),
        (Q, None, ["empty"]), (Q, "", ["empty"]), (Q, " \n ", ["empty"]), (Q, "<p></p>", ["empty"]), (Q, "n/a", ["empty"]), (Q, "(no answer)", ["empty"]), (Q, "​", ["empty"]), (Q, "Answer:", ["empty"]),
        (Q, "No.", []), (Q, "Yes, AB-123.", []), (Q, "420 ppm", []), (Q, "Code AB-123C", []), (Q, "RS-485 and relay", []), (Q, "3 % v/v", []),
        (Q, "The wall unit settles within", ["truncated"]), (Q, "The wall unit draws 4 mA", ["truncated"]), (Q, ANSWER + " Further details (see the", ["truncated"]), (Q, ANSWER + " Spare no.", ["truncated"]),
        (Q, ANSWER + " Hope this helps :)", []), (Q, ANSWER + " (see AB-123)", []), (Q, ANSWER + '"', []),
        (Q, "- lamp: 3 ppm\n- pump: 4 ppm", []), (Q, "- lamp: 3 ppm\n- pu", ["truncated"]), (Q, "1. One thing is done.\n2. The", ["truncated"]), (Q, "1. One thing is done.\n2.", ["truncated"]),
        (Q, "| Item | Value |\n|---|---|\n| lamp | 3 ppm |", []), (Q, "| Item | Value |\n|---|---|\n| lamp | 3 ppm |\n| pu", ["truncated"]),
        (Q, "I'm sorry, but I can't help with questions about the wall unit.", ["refusal"]), (Q, "We can't recommend the old unit; take the new one with code AB-123.", []), (Q, "This detail is not in the approved material for code AB-123.", []),
        (Q, "I am not able to see a conflict between the two units.", []), (Q, "It is not allowed to open the unit.", []), (Q, "Sorry for the earlier mix-up: the unit needs 3 minutes.", []), (Q, "I won't answer this one.", ["refusal"]),
        ("¿Qué sensor sirve para la caldera?", "No puedo ayudar con esa consulta.", ["refusal"]), ("Wie oft muss der Regler geprüft werden?", "Dazu kann ich leider keine Auskunft geben.", ["refusal"]),
        (Q, Q, ["copy"]), (Q, Q.upper(), ["copy"]), (Q, f'You asked: "{Q}"', ["copy"]), (Q, f"{Q} {Q}", ["copy"]), (Q, f"{Q} {ANSWER}", []), (Q, Q[:-1], ["copy"]),
        (Q, "Le filtre fixe doit être contrôlé une fois par trimestre dans la salle.", ["language"]), (Q, "更换探头后请记录编号。", ["language"]), (Q, "डिस्प्ले बदलने के बाद संख्या लिखें।", ["language"]),
        ("¿Cada cuánto se revisa el filtro?", "El filtro debe revisarse cada dos meses.", []), ("¿Cada cuánto se revisa el filtro?", "AB-123, CD-456.", []),
        (Q, "Le filtre fixe doit être contrôlé une fois par", ["truncated", "language"]), (None, ANSWER, []), (None, None, ["empty"]),
    ],
)
def test_defects(question, answer, want):
    assert defects(question, answer) == want


def test_table(spark):
    rows = [(1, Q, None, "correct"), (1, Q, None, "wrong"), (2, Q, ANSWER, None), (3, Q, "The wall", "x"), (4, None, "word " * 50000, "x"), (None, Q, "", None)]
    df = spark.createDataFrame(rows, "id bigint, question string, answer string, defect string")
    got = {tuple(r) for r in broken_pairs(df).collect()}
    assert got == {(1, "empty"), (3, "truncated"), (4, "truncated"), (None, "empty")}
    assert broken_pairs(df.limit(0)).count() == 0


#: Sentences of languages and subjects that none of the tables has.
OTHERS = {
    "pt": ["O comboio para o norte parte às oito e não para em todas as estações.", "Os livros que você pediu chegam na próxima semana pelo correio.", "Quando a chuva acaba, as crianças brincam no jardim até ao jantar."],
    "it": ["Il treno per il nord parte alle otto e non si ferma in ogni stazione.", "I libri che avete ordinato arrivano la prossima settimana con la posta.", "Dopo la pioggia i bambini giocano nel giardino fino alla cena."],
    "nl": ["De trein naar het noorden vertrekt om acht uur en stopt niet op elk station.", "De boeken die u besteld heeft komen volgende week met de post aan.", "Na de regen spelen de kinderen in de tuin tot het eten klaar is."],
    "pl": ["Pociąg na północ odjeżdża o ósmej i nie zatrzymuje się na każdej stacji.", "Zamówione książki przyjdą pocztą w przyszłym tygodniu, jeśli nie ma opóźnień.", "Po deszczu dzieci bawią się w ogrodzie, ale tylko do kolacji."],
    "sv": ["Tåget till norr går klockan åtta och stannar inte vid varje station.", "Böckerna som ni har beställt kommer med posten nästa vecka.", "Efter regnet leker barnen i trädgården tills det är dags för middag."],
    "ru": ["Поезд на север отправляется в восемь и останавливается не на каждой станции.", "Заказанные книги придут почтой на следующей неделе.", "После дождя дети играют в саду до ужина."],
    "cs": ["Vlak na sever odjíždí v osm hodin a nezastavuje na každé stanici, protože je rychlý a není místní.", "Objednané knihy přijdou poštou, když se nic nestane, ale ne před pondělím."],
    "hu": ["A vonat nyolckor indul északra, és nem áll meg minden állomáson, mert gyors.", "Az eső után a gyerekek a kertben játszanak, amíg meg nem jön a vacsora."],
    "tr": ["Kuzeye giden tren saat sekizde kalkıyor ve her istasyonda durmuyor, daha sonra bir tane daha var.", "Yağmurdan sonra çocuklar bahçede oynuyor, ama akşam için bir şey yok."],
    "ja": ["北へ行く電車は八時に出て、すべての駅には止まりません。"], "ko": ["북쪽으로 가는 기차는 여덟 시에 출발합니다."], "el": ["Το τρένο για τον βορρά φεύγει στις οκτώ."], "ar": ["يغادر القطار إلى الشمال في الساعة الثامنة."],
}
DECLINED = {
    "en": ["I am not going to get into that one.", "We are not in a position to answer that.", "Sorry, can't help with that request."],
    "it": ["Non posso rispondere a questa domanda.", "Preferisco non parlarne."], "pt": ["Não posso ajudar com essa questão.", "Prefiro não responder."], "nl": ["Daar kan ik niet op antwoorden.", "Ik kan deze vraag niet beantwoorden."],
    "pl": ["Nie mogę odpowiedzieć na to pytanie."], "sv": ["Jag kan inte svara på den frågan."], "ru": ["Я не могу ответить на этот вопрос."],
}


def test_other_languages():
    english = "Which train goes to the north and where does it stop?"
    each = [(k, t) for k, ts in OTHERS.items() for t in ts]
    missed = [(k, t) for k, t in each if defects(english, t) != ["language"]]
    assert len(missed) <= 0.05 * len(each), missed
    for k, t in each:  # a question in the same language
        assert "language" not in defects(OTHERS[k][0], t)
    german = "Wann fährt der Zug nach Norden und wo hält er?"
    assert sum(defects(german, t) != ["language"] for _, t in each) <= 0.05 * len(each)
    assert defects(german, "Er fährt um acht ab und hält nicht an jedem Bahnhof.") == []


def test_other_refusals():
    for k, ts in DECLINED.items():
        for t in ts:
            assert "refusal" in defects(OTHERS.get(k, ["Where does the train stop?"])[0], t), t
    for t in ("The relay can't provide support for that topic load.", "The pump cannot offer that flow here.", "Il sensore non può rispondere prima di dieci secondi.", "The old unit will not give this signal.", "O sensor não pode ajudar em caso de chuva."):
        assert "refusal" not in defects(None, t), t


def test_copied_prefixes_and_whole_rules():
    assert defects(Q, "What is the response time of the") == ["truncated", "copy"]
    assert defects(Q, "What is") == ["truncated"]  # too little to tell
    assert defects("Can you not answer this? I can't help with that.", "Can you not answer this? I can't help with that.") == ["copy"]
    assert defects(Q, "Non posso rispondere a questa") == ["truncated", "refusal", "language"]
