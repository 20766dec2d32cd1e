"""The language model on sentences that its samples don't hold."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import language

HELD_OUT = {
    "English": ["Compute the mean of each column and explain your findings below.", "This notebook shows how to train a simple classifier.", "Let us import the libraries that we need"],
    "French": ["Calculez la moyenne de chaque colonne et expliquez vos résultats."], "Spanish": ["Calcula la media de cada columna y explica los resultados a continuación."],
    "German": ["Berechne den Mittelwert jeder Spalte und erkläre die Ergebnisse."], "Italian": ["Calcola la media di ogni colonna e spiega i risultati qui sotto.", "Questo quaderno mostra come addestrare un semplice classificatore."],
    "Dutch": ["Bereken het gemiddelde van elke kolom en leg je bevindingen hieronder uit.", "Dit notitieboek laat zien hoe je een eenvoudige classificator traint."],
    "Portuguese": ["Calcule a média de cada coluna e explique os resultados abaixo."], "Swedish": ["Beräkna medelvärdet av varje kolumn och förklara resultaten nedan."], "Danish": ["Beregn gennemsnittet af hver kolonne og forklar resultaterne nedenfor."],
    "Polish": ["Oblicz średnią każdej kolumny i wyjaśnij wyniki poniżej."], "Turkish": ["Her sütunun ortalamasını hesaplayın ve sonuçları açıklayın."], "Czech": ["Spočítejte průměr každého sloupce a vysvětlete výsledky."],
    "Finnish": ["Laske jokaisen sarakkeen keskiarvo ja selitä tulokset."], "Indonesian": ["Hitung rata-rata setiap kolom dan jelaskan hasilnya di bawah ini."], "Romanian": ["Calculați media fiecărei coloane și explicați rezultatele."],
    "Hungarian": ["Számítsd ki minden oszlop átlagát és magyarázd el az eredményeket."], "Vietnamese": ["Tính giá trị trung bình của mỗi cột và giải thích kết quả."],
    "Chinese": ["计算每一列的平均值并解释结果", "这个笔记本展示如何训练一个简单的分类器"], "Japanese": ["各列の平均を計算して、結果を説明してください。"], "Korean": ["각 열의 평균을 계산하고 결과를 설명하세요"],
    "Russian": ["Вычислите среднее значение каждого столбца и объясните результаты."], "Ukrainian": ["Обчисліть середнє значення кожного стовпця і поясніть результати"], "Greek": ["Υπολογίστε τον μέσο όρο κάθε στήλης"],
    "Arabic": ["احسب متوسط كل عمود"], "Persian": ["میانگین هر ستون را حساب کنید و گزارش دهید"], "un": ["", "x", "df 12 !!", "\ud800 ??", "1 + 2 = 3"],
}


@pytest.mark.parametrize("name", HELD_OUT)
def test_held_out_sentences(name):
    assert {language.guess(x) for x in HELD_OUT[name]} == {name}


def test_whole_texts_decide_and_null_fails(spark):
    long = "les données " * 40_000 + "the data"
    frame = spark.createDataFrame([(1, long), (2, None), (3, "Write the code and run it. " * 3)], "id long, text string")
    got = {r[0]: r[1] for r in frame.select("id", language.detect_language(F.col("text"))).collect()}
    assert got == {1: "French", 2: "failed", 3: "English"}


def test_mixed_texts_are_unsure_rather_than_wrong():
    assert language.guess("the data et les données de la and of the valeurs with des résultats") in ("un", "English", "French")
