"""Labelled questions, fixed values: the intent model learns from these."""

ROWS = {
    "mezuniyet_durumu": (
        "Mezuniyetime kaç kredi kaldı?",
        "Mezun oluyor muyum?",
        "Hangi dersleri vermem gerekiyor mezuniyet için?",
        "Required ve core eksiklerimi hesapla",
        "Kaç SU kredim eksik?",
        "Ne zaman mezun olurum?",
    ),
    "ders_onerisi": (
        "Önümüzdeki dönem için ders önerir misin?",
        "NLP alanında hangi dersleri almalıyım?",
        "Bana kolay 5 tane ders programı yap",
        "Data science dersleri listele",
        "Ders programı oluşturmak istiyorum",
    ),
    "calisma_plani": (
        "Data structures dersine nasıl çalışmalıyım?",
        "Machine learning dersini geçmek için tavsiyeler",
        "CS300 için çalışma planı yap",
        "Bu dersin sınavlarına nasıl hazırlanılır?",
        "Dersi A ile geçmek için ne yapmalıyım?",
    ),
    "major_secimi": (
        "Hangi bölümü seçmeliyim?",
        "CS mi yoksa Endüstri mi yazmalıyım?",
        "Bilgisayar bilimleri seçmek mantıklı mı?",
        "Major seçimi konusunda kararsızım yardım et",
        "Hangi ana dal bana uygun?",
    ),
    "alanda_ozellesme": (
        "CS seçtim ama NLP mi yoksa Security mi yönelmeliyim?",
        "Bilgisayar bilimlerinde data alanında uzmanlaşmak",
        "Yapay zeka alanında özelleşmek için ne yapmalıyım?",
        "Hangi alt dalı seçmeliyim?",
    ),
    "ders_ayrintisi": (
        "CS 412 dersini kim veriyor?",
        "Yücel Saygın'ın dersi zor mu?",
        "Bu dersin syllabus'ı nedir?",
        "Bu dersi neden almalıyım, projeleri ağır mı?",
        "Hocanın notlandırması nasıl?",
        "Dersin içeriği ne?",
    ),
    "diger": (
        "Merhaba nasılsın?",
        "Okulun yemekhanesi nerede?",
        "Şifremi unuttum",
        "Teşekkür ederim",
        "Bugün hava nasıl?",
        "Selam",
        "Sistemi kim yaptı?",
    ),
}
