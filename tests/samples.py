"""Paths and small files that the tests share (a module of its own name: a
``conftest`` of a sub-folder would shadow this one)."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

# Small files with one trap each: values that confirm a column, a column that
# only its name gives away, personal data in a log call, a literal secret.
CUSTOMERS_CSV = """ref,email,ssn,town
r-7,olga@shop.test,321-54-9876,Bern
r-8,ivan@shop.test,222-33-4444,Lima
r-9,mei@shop.test,111-22-3333,Oslo"""

PATIENTS_CSV = """case_no,diagnosis,ward
C7,Asthma,3
C8,Migraine,5"""

AUTH_CS = """namespace Shop;

class Mailer
{
    // writes who got a mail
    void Sent(Person p, ILog log)
    {
        log.LogWarning("mail to {0}", p.Email);
    }
}"""

CONFIG_CS = """namespace Shop;

static class Keys
{
    const string ApiKey = "not-a-real-key";
    const string Zone = "north";
}"""
