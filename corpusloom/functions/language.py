"""Markdown to words, and the language of a text by a character model."""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from .markdown import render
from .slices import by_value

# Plain sentences and frequent words from which the model of each language in Latin script is counted.
SAMPLES = {
    "English": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. In this exercise we will load the data, clean the missing values and plot the results. What do you see when you look at each of these? Write a function that returns the answer. the of and to in is that for it was on are with as be this have from or by not but at an they which you his were had has been their there would what when who will more if out so can about into than them these some could",
    "French": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Dans cet exercice nous allons charger les données, nettoyer les valeurs manquantes et tracer les résultats. Que voyez-vous quand vous regardez chacune d'elles? Écrivez une fonction qui renvoie la réponse. le la les de des et un une est que qui dans pour sur pas au avec ce il sont du en par plus ne se cette nous vous elle mais ou où être fait aux comme son ses leur",
    "Spanish": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. En este ejercicio vamos a cargar los datos, limpiar los valores que faltan y dibujar los resultados. ¿Qué ves cuando miras cada uno de ellos? Escribe una función que devuelva la respuesta. el la los las de y que en un una es por con para no se del al lo como más pero sus su o este esta ya son fue cuando muy sin sobre también me hasta hay donde",
    "German": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. In dieser Übung laden wir die Daten, bereinigen die fehlenden Werte und zeichnen die Ergebnisse. Was siehst du, wenn du jede davon betrachtest? Schreibe eine Funktion, welche die Antwort zurückgibt. der die das und ist in den von zu mit sich des auf für nicht ein eine dem im als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch",
    "Italian": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. In questo esercizio carichiamo i dati, puliamo i valori mancanti e disegniamo i risultati. Che cosa vedi quando guardi ciascuno di questi? Scrivi una funzione che restituisce la risposta. il lo la i gli le di che e un una è per con non si del della dei nel alla come più ma anche sono da al questo quella ha hanno essere loro quando molto dopo tra perché ogni",
    "Portuguese": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Neste exercício vamos carregar os dados, limpar os valores em falta e desenhar os resultados. O que você vê quando olha para cada um deles? Escreva uma função que devolve a resposta. o a os as de do da dos das e que em um uma é por com para não se no na como mais mas seu sua ou este esta já são foi quando muito sem sobre também até há onde ao pelo pela ele ela isso",
    "Dutch": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. In deze oefening laden we de gegevens, ruimen de ontbrekende waarden op en tekenen de resultaten. Wat zie je als je naar elk daarvan kijkt? Schrijf een functie die het antwoord teruggeeft. de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij uit door naar hij zij wordt heeft deze nog wel dan over meer tot werd kan geen worden hun hebben wat",
    "Swedish": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. I den här övningen läser vi in data, rensar de värden som saknas och ritar resultaten. Vad ser du när du tittar på var och en av dem? Skriv en funktion som returnerar svaret. och att det som en på är av för med den till inte om har de ett han men var jag sig från vi så kan nu under vid eller detta skulle hade alla blev mycket när",
    "Danish": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. I denne øvelse indlæser vi data, renser de manglende værdier og tegner resultaterne. Hvad ser du, når du kigger på hver af dem? Skriv en funktion, som returnerer svaret. og at det som en på er af for med den til ikke om har de et han men var jeg sig fra vi så kan nu under ved eller dette skulle havde alle blev meget når hvor efter",
    "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. W tym ćwiczeniu wczytamy dane, usuniemy brakujące wartości i narysujemy wyniki. Co widzisz, kiedy patrzysz na każdy z nich? Napisz funkcję, która zwraca odpowiedź. i w na z do się nie że to jest o jak po od za przez ale dla co tak już tylko był jego są czy może które która oraz który było przed także",
    "Czech": "Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. V tomto cvičení načteme data, vyčistíme chybějící hodnoty a vykreslíme výsledky. Co vidíte, když se podíváte na každý z nich? Napište funkci, která vrátí odpověď. a se v na je že o s z do i to k ve pro za by ale si po jako od jsou který které bylo jeho také než nebo až být jen však",
    "Turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Bu alıştırmada verileri yükleyip eksik değerleri temizleyecek ve sonuçları çizeceğiz. Her birine baktığınızda ne görüyorsunuz? Cevabı döndüren bir fonksiyon yazın. ve bir bu da de için ile çok olarak daha olan gibi kadar en ne var sonra o her ama mi ki ya değil olduğu göre ben sen",
    "Indonesian": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Dalam latihan ini kita akan memuat data, membersihkan nilai yang hilang dan menggambar hasilnya. Apa yang kamu lihat ketika melihat masing-masing? Tulislah fungsi yang mengembalikan jawabannya. yang dan di ini itu dengan untuk dari dalam tidak akan pada juga ke karena adalah oleh saya ada bisa mereka lebih sudah atau seperti kita telah",
    "Romanian": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. În acest exercițiu vom încărca datele, vom curăța valorile lipsă și vom desena rezultatele. Ce vezi când te uiți la fiecare dintre ele? Scrie o funcție care întoarce răspunsul. și de în a la cu pe nu este că din mai pentru care o un se sunt au fost prin ca dar să lui sau după când",
    "Finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Tässä harjoituksessa lataamme tiedot, poistamme puuttuvat arvot ja piirrämme tulokset. Mitä näet, kun katsot kutakin niistä? Kirjoita funktio, joka palauttaa vastauksen. ja on ei se että oli hän mutta joka kun niin myös tai sen mukaan ovat jos kuin olla vain jo nyt ole sitä",
    "Hungarian": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Ebben a feladatban betöltjük az adatokat, eltávolítjuk a hiányzó értékeket és kirajzoljuk az eredményeket. Mit látsz, amikor megnézed őket? Írj egy függvényt, amely visszaadja a választ. a az és hogy nem is egy ez de csak meg már még volt mint vagy van ha el azt lehet akkor minden",
    "Vietnamese": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Trong bài tập này chúng ta sẽ tải dữ liệu, làm sạch các giá trị bị thiếu và vẽ kết quả. Bạn thấy gì khi nhìn vào từng cái? Hãy viết một hàm trả về câu trả lời. và của là có không một các được người trong cho đã với những này từ để khi ra đến",
}
# First and last code point of blocks of letters, by script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)], "Cyrillic": [(0x400, 0x52F)], "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "Hebrew": [(0x590, 0x5FF)],
    "Devanagari": [(0x900, 0x97F)], "Thai": [(0xE00, 0xE7F)], "Hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)], "Kana": [(0x3040, 0x30FF)], "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
}
# The language that a script stands for, and letters that only another language of it has.
BY_SCRIPT = {"Cyrillic": "Russian", "Greek": "Greek", "Arabic": "Arabic", "Hebrew": "Hebrew", "Devanagari": "Hindi", "Thai": "Thai", "Hangul": "Korean", "Kana": "Japanese", "Han": "Chinese"}
TELLING = {"Russian": [("Ukrainian", "іїєґ")], "Arabic": [("Persian", "پچژگ")]}
#: Below so many letters, or so small a margin of the log likelihood a letter over the next language, the answer is `un`.
LEAST_LETTERS, LEAST_MARGIN = 12, 0.04
#: Share of a language's model that is spread over all that its sample doesn't hold.
SPREAD = 0.08


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case text, runs of anything but letters being one space each, with a space at either end."""
    return np.frombuffer(f" {re.sub(r'[\W\d_]+', ' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def runs_of_three(points: np.ndarray) -> np.ndarray:
    """A number for each three neighbouring code points that don't span two words."""
    if len(points) < 3:
        return np.zeros(0, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    return ((a << 42) | (b << 21) | c)[b != 32]


@functools.cache
def model() -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, the numbers of all runs in the samples in order, their log likelihoods by language with a last row for any other run)."""
    counts = [dict(zip(*np.unique(runs_of_three(letters_of(s)), return_counts=True), strict=True)) for s in SAMPLES.values()]
    known = np.array(sorted(set().union(*counts)), np.int64)
    found = np.array([[c.get(k, 0) for k in known] for c in counts], float)
    share = (1 - SPREAD) * found / found.sum(axis=1, keepdims=True) + SPREAD / (4 * len(known))
    return list(SAMPLES), known, np.log(np.vstack([share.T, np.full(len(counts), SPREAD / (4 * len(known)))]))


def script_of(points: np.ndarray) -> tuple[str | None, int]:
    """(the script of most letters, how many letters there are); kana among Han mean kana."""
    n = {name: int(sum(((points >= a) & (points <= b)).sum() for a, b in blocks)) for name, blocks in SCRIPTS.items()}
    total = sum(n.values())
    if not total:
        return None, 0
    if n["Kana"] and n["Kana"] * 10 >= n["Han"]:
        n["Kana"] += n["Han"]
    return max(n, key=lambda k: n[k]), total


def guess(text: str | None) -> str:
    """The language of a text: by its script, or for Latin script the likeliest under a model of runs of three letters; `un` if there are too few letters or the next language is about as likely, `failed` for null."""
    if text is None:
        return "failed"
    points = letters_of(text)
    script, n = script_of(points)
    if script is None or (script == "Latin" and n < LEAST_LETTERS):
        return "un"
    if script != "Latin":
        name = BY_SCRIPT[script]
        return next((other for other, signs in TELLING.get(name, ()) if np.isin(points, [ord(x) for x in signs]).any()), name)
    names, known, likely = model()
    runs = runs_of_three(points)
    at = np.searchsorted(known, runs)
    at[at == len(known)] = 0
    score = likely[np.where(known[at] == runs, at, len(known))].sum(axis=0) / len(runs)
    best, second = np.argsort(-score)[:2]
    return names[best] if score[best] - score[second] >= LEAST_MARGIN else "un"


def detect_language(text: Column) -> Column:
    return by_value(guess, "string", pa.string(), text)


def tokens(markdown: str | None) -> list[str] | None:
    """Words and punctuation of rendered markdown, CTAG for code tags."""
    if markdown is None:
        return None
    text = render(markdown).replace("<code>", " CTAG ").replace("</code>", " CTAG ")
    return re.findall(r"\w+(?:[-']\w+)*|[^\w\s]", html.unescape(re.sub(r"<.*?>", "", text)))


def nl_tokens(markdown: Column) -> Column:
    return by_value(tokens, "array<string>", pa.list_(pa.string()), markdown)


def has_code_tag(markdown: Column) -> Column:
    return by_value(lambda x: x is not None and "<code>" in render(x), "boolean", pa.bool_(), markdown)
