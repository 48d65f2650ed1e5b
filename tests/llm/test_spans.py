"""Secret scans and personal data against the plain patterns."""

import hashlib
import random
import re

from conftest_llm import ODD, texts_of

from sparkweave.llm import pii, secrets


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def noisy(rng, parts):
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))


SECRET_PARTS = ["password", "PassWD", "api_key", "apikey", "ſecret", "TOKEN", '"', "'", " ", ":", "=", "abc", "A1b2C3", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", ".", "/"]
PII_PARTS = ["a.b", "@", "@", ".", "mail", "x-y", "1", "25", "255", "256", "999", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "4111111111111112", "+1 (375) 555-4393", "10.0.0.1", "é", "\n", "0"]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(9)
    model = pii.fit_votes({})
    texts = [t or "" for _, t, _ in texts_of()]
    for t in texts + [noisy(rng, SECRET_PARTS) for _ in range(3000)]:
        assert sorted(secrets.base_spans(t, t.encode())) == sorted(plain_secrets(t)), t
    for t in texts + [noisy(rng, PII_PARTS) for _ in range(3000)]:
        assert sorted(pii.find_pii(t, model)[0]) == sorted(plain_pii(t)), t


def test_novel_secrets():
    n = secrets.Novelty()
    base, more = secrets.find_secrets("the private signing material was 9fQ2xLr7TzB1mVw4KcJ8yHd3 yesterday", n)
    assert not base and [k for k, _, _ in more] == ["novel"]
    for t in ("the private house at 1234567890-1234567890-1234567890 street", "auth uses abcdefghijklmnopqrstuvwxyz0123456789 here", "the garden has 9fQ2xLr7TzB1mVw4KcJ8yHd3 in it"):
        assert not secrets.find_secrets(t, n)[1], t


def test_secret_rows(spark, docs_of):
    df = docs_of([*ODD, (30, 'é token = "0641917ea4e9feb9cda83477b57ac2654884f485" x')])
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    r = got[30]
    assert (r["n_assign"], r["n_hex"], r["n_access"]) == (1, 1, 0) and r["spans"].startswith("assign:2:") and r["spans"].count(",") == 1
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[7]["n_hex"] == 1
    assert secrets.scan_secrets(df).count() == len(ODD) + 1 and secrets.scan_secrets(df.limit(0)).count() == 0


def test_votes_teach_a_classifier():
    good, bad = (1, 1, 1, 1, 0, 0), (1, -1, 0, 0, -1, -1)
    model = pii.fit_votes({("phone", good, 2): 60, ("phone", bad, 2): 60, ("name", (1, 0, 1, 1, 0, 0), 2): 20})
    keeps = lambda kind, v: model.keeps(pii.Candidate(kind, 0, 12, False, v, 2))
    assert keeps("phone", good) and keeps("name", (1, 0, 1, 1, 0, 0)) and not keeps("phone", bad)
    assert model.reliability[1, 1, 2] > model.reliability[1, 0, 2]


def test_pii_rows_and_masks(spark, docs_of):
    df = docs_of([*ODD, (30, "Write to é.x@mail.example.com or call +1 (375) 555-4393 from 10.0.0.1, card 4111 1111 1111 1111."), (31, "My name is Anna Smith, please call 555-123-4567 soon."), (32, "Plain prose stays.")])
    model = pii.fit_pii(df)
    got = {r["doc_id"]: r for r in pii.label_pii(df, model).collect()}
    assert [got[30][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1] and got[32]["spans"] == "" and "name:" in got[31]["spans"] and "phone:" in got[31]["spans"]
    out = pii.mask_pii(df, model)
    masked = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == df.columns and out.count() == df.count() and masked[1] is None and masked[32] == "Plain prose stays."
    assert masked[30] == "Write to é<EMAIL> or call <PHONE> from <IP>, card <CARD>." and "Anna" not in masked[31]
    assert pii.label_pii(df.limit(0), pii.fit_pii(df.limit(0))).count() == 0


def test_novel_values_of_assignments():
    n = secrets.Novelty()
    value = "kJ8s7df6Qx2mVw4TzB1rLc9P"
    for head in ("export AWS_SECRET_ACCESS_KEY=", "DB_AUTH=", "https://x.example/p?a=1&auth=", "--private-key=", "MY_LOGIN='", "auth: ", "SIGN_SALT=="):
        t = f"{head}{value} then"
        assert f"novel:{len(head)}:{len(head) + len(value)}" in secrets.joined(secrets.find_secrets(t, n)[1], secrets.KINDS), t
    letters = "qWzXpLmNvBtRkJhGfDsA"
    for t in (f"DB_AUTH={letters}", f"the private material was {letters} then", "auth = zqxwvkjhgfpmtrbnd"):
        assert [k for k, _, _ in secrets.find_secrets(t, n)[1]] == ["novel"], t
    for t in ("the key is characteristically counterrevolutionaries", f"PLAIN_SIZE={value}", "auth ====================", "the key is in AuthenticationManagerBuilder"):
        assert not secrets.find_secrets(t, n)[1], t


def test_long_texts_take_linear_time():
    import time

    n, model = secrets.Novelty(), pii.fit_votes({})

    def took(run, text):
        began = time.perf_counter()
        run(text)
        return time.perf_counter() - began

    some = {"secrets": (lambda t: secrets.find_secrets(t, n), "token=abcdef12 the qQ7xLr9TzB1mVw4K is "), "pii": (lambda t: pii.find_pii(t, model), "a@b.de 555-123-4567 ")}
    for run, part in some.values():
        assert min(took(run, part * 20_000) for _ in range(2)) < 3.2 * min(took(run, part * 10_000) for _ in range(2))


def test_long_numbers_are_no_error():
    model = pii.fit_votes({})
    for t in ("0" * 5000 + ".0.0.0", "0" * 5000 + "1.2.3.4", "1.2.3." + "9" * 5000):
        pii.find_pii(t, model)
    assert pii.find_pii("0" * 5000 + ".0.0.0", model)[0] == [("ip", 0, 5006)]


def test_names_in_the_languages_of_the_corpus():
    found = lambda t: [t[c.start : c.end] for c in pii.candidates(t) if c.kind == "name"]
    assert found("My name is José García, hola") == ["José García"] and found("ich heiße Jürgen Müller und") == ["Jürgen Müller"]
    assert found("je m'appelle Zoë Lefèvre.") == ["Zoë Lefèvre"] and found("Me llamo Ana Núñez Gil") == ["Ana Núñez Gil"] and found("the name is on the door") == []


def test_planted_secrets_in_generated_code():
    """Precision and recall of what the method adds beside the fixed patterns."""
    import base64
    import uuid

    rng, n = random.Random(12), secrets.Novelty()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hit = missed = wrong = clean = 0
    for _ in range(300):
        value = rng.choice([lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 44))), lambda: base64.b64encode(rng.randbytes(24)).decode().rstrip("=")])()
        t = rng.choice([f"export DB_AUTH={value}\n", f'client = connect(host="db", credential="{value}")\n', f"Authorization: Bearer {value}\n", f"https://api.example.com/v1?auth={value}&page=2\n", f"# private signing key {value}\n"])
        at = t.index(value)
        base, more = secrets.find_secrets("import os\n" + t + "return config\n", n)
        ok = any(s <= at + 10 < e for _, s, e in base + more)
        hit, missed = hit + ok, missed + (not ok)
        ident = rng.choice([str(uuid.UUID(int=rng.getrandbits(128))), "get_authentication_session_manager", "AbstractSessionFactoryBean", "session_2024_01_01_000000", "https_example_com_path_index_html", "configuration_service_endpoint_url"])
        t = rng.choice([f"session {ident} was opened\n", f"the key class is {ident}\n", f"login uses {ident} here\n"])
        base, more = secrets.find_secrets(t, n)
        wrong, clean = wrong + bool(more), clean + 1
    assert hit / (hit + missed) >= 0.95 and wrong / clean <= 0.05, (hit, missed, wrong, clean)


def test_paths_and_class_names_are_no_secrets_but_keys_in_the_same_places_are():
    rng, n = random.Random(31), secrets.Novelty()
    low = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    key = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    around = [
        (lambda x: f"the api is at https://api.example.com/{x} for login", lambda: f"v1/users/{low(8)}/orders/list_all_items"),
        (lambda x: f"see session docs under https://auth.example.org/{x} today", lambda: f"docs/{low(7)}-{low(6)}/2024/{low(9)}_guide"),
        (lambda x: f"the token class {x} is final", lambda: f"SessionToken{low(6).title()}ProviderImpl{rng.randrange(100)}"),
        (lambda x: f"the secret manager calls {x} first", lambda: f"{low(7)}Credential{low(6).title()}Factory{rng.randrange(10)}"),
    ]
    harmless = [wrap(make()) for wrap, make in around for _ in range(50)]
    keys = [(wrap(k), k) for wrap, _ in around for k in (key(rng.randint(24, 44)) for _ in range(50))]
    assert sum(bool(secrets.find_secrets(t, n)[1]) for t in harmless) <= 0.05 * len(harmless)
    found = 0
    for t, k in keys:
        at = t.index(k)
        base, more = secrets.find_secrets(t, n)
        found += any(s <= at and at + len(k) <= e for _, s, e in base + more)
    assert found >= 0.95 * len(keys)
