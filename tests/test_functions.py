"""Published values of functions, and how errors travel."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import FUNCTIONS, call, dates, number

VECTORS = [
    lambda: ('ROUND',(2.675,2),2.68),
    lambda: ('ROUND',(-2.5,0),-3.0),
    lambda: ('ROUNDUP',(1.21,1),1.3),
    lambda: ('ROUNDDOWN',(-1.29,1),-1.2),
    lambda: ('TRUNC',(8.9,),8.0),
    lambda: ('ROUND',(1234.5,-2),1200.0),
    lambda: ('MOD',(3,-2),-1.0),
    lambda: ('MOD',(1,0),'#DIV/0!'),
    lambda: ('CEILING',(2.5,1),3.0),
    lambda: ('FLOOR',(2.5,0),'#DIV/0!'),
    lambda: ('CEILING.MATH',(-5.5,2,1),-6.0),
    lambda: ('FACT',(5,),120.0),
    lambda: ('FACTDOUBLE',(7,),105.0),
    lambda: ('COMBIN',(8,2),28.0),
    lambda: ('PERMUT',(5,2),20.0),
    lambda: ('GCD',(24,36),12.0),
    lambda: ('LCM',(4,6),12.0),
    lambda: ('ROMAN',(1994,),'MCMXCIV'),
    lambda: ('ARABIC',('MCMXCIV',),1994.0),
    lambda: ('BASE',(7,2,5),'00111'),
    lambda: ('DECIMAL',('FF',16),255.0),
    lambda: ('SQRT',(-1,),'#NUM!'),
    lambda: ('MULTINOMIAL',(2,3,4),1260.0),
    lambda: ('EVEN',(1.5,),2.0),
    lambda: ('ODD',(-1.5,),-3.0),
    lambda: ('MROUND',(10,3),9.0),
    lambda: ('LEFT',('hello',2),'he'),
    lambda: ('RIGHT',('hello',3),'llo'),
    lambda: ('MID',('hello',2,3),'ell'),
    lambda: ('PROPER',("o'neil 2nd-floor",),"O'Neil 2Nd-Floor"),
    lambda: ('TRIM',('  a   b ',),'a b'),
    lambda: ('SUBSTITUTE',('a-b-c','-','+',2),'a-b+c'),
    lambda: ('SUBSTITUTE',('a-b-c','-','+'),'a+b+c'),
    lambda: ('FIND',('l','hello',4),4.0),
    lambda: ('FIND',('z','hello'),'#VALUE!'),
    lambda: ('SEARCH',('L','hello'),3.0),
    lambda: ('REPLACE',('abcdef',2,3,'X'),'aXef'),
    lambda: ('TEXTJOIN',('-',True,'a','','b'),'a-b'),
    lambda: ('NUMBERVALUE',('1.234,5%',',','.'),12.345),
    lambda: ('UNICHAR',(8364,),'€'),
    lambda: ('CODE',('é',),233.0),
    lambda: ('REPT',('ab',3),'ababab'),
    lambda: ('VALUE',('12%',),0.12),
    lambda: ('VALUE',('x',),'#VALUE!'),
    lambda: ('CONCATENATE',('a',1,True,2.5,None),'a1TRUE2.5'),
    lambda: ('CONCATENATE',(1e21,),'1E+21'),
    lambda: ('CONCATENATE',(0.1+0.2,),'0.3'),
    lambda: ('CONCATENATE',(123456.789012345678,),'123456.789012346'),
    lambda: ('CONCATENATE',(1200.0,),'1200'),
    lambda: ('DATE',(2024,1,31),45322.0),
    lambda: ('DATE',(1900,1,1),1.0),
    lambda: ('DATE',(2024,14,1),45689.0),
    lambda: ('EDATE',(45322,1),45351.0),
    lambda: ('EOMONTH',(45322,0),45322.0),
    lambda: ('WEEKDAY',(45292,),2.0),
    lambda: ('WEEKNUM',(45292,),1.0),
    lambda: ('YEAR',(45292,),2024.0),
    lambda: ('DAY',(60,),29.0),
    lambda: ('DAY',(61,),1.0),
    lambda: ('YEARFRAC',(45292,45474,1),182/366),
    lambda: ('DAYS360',(45292,45474),180.0),
    lambda: ('DATEDIF',(45292,45474,'M'),6.0),
    lambda: ('DATEVALUE',('2024-01-01',),45292.0),
    lambda: ('TIMEVALUE',('1:30 PM',),0.5625),
    lambda: ('TIME',(25,0,0),1/24),
    lambda: ('HOUR',(0.75,),18.0),
    lambda: ('BIN2DEC',('1111111111',),-1.0),
    lambda: ('DEC2HEX',(-1,),'FFFFFFFFFF'),
    lambda: ('DEC2BIN',(9,6),'001001'),
    lambda: ('HEX2BIN',('F',),'1111'),
    lambda: ('BITAND',(13,25),9.0),
    lambda: ('BITLSHIFT',(4,2),16.0),
    lambda: ('CONVERT',(1,'mi','km'),1.609344),
    lambda: ('CONVERT',(1,'mi','kg'),'#N/A'),
    lambda: ('COMPLEX',(3,4),'3+4i'),
    lambda: ('IMABS',('3+4i',),5.0),
    lambda: ('IMPRODUCT',('3+4i','5-3i'),'27+11i'),
    lambda: ('IMSUM',('3+4i','-i'),'3+3i'),
    lambda: ('IMREAL',('1e3-2j',),1000.0),
    lambda: ('ERF',(1,),0.8427007929497149),
    lambda: ('NORM.S.DIST',(1.333333,True),0.908788725604095),
    lambda: ('NORM.S.INV',(0.908789,),1.3333347),
    lambda: ('T.DIST.2T',(1.959999998,60),0.054644930),
    lambda: ('CHISQ.INV',(0.93,1),3.283020287),
    lambda: ('F.DIST.RT',(15.20686486,6,4),0.01),
    lambda: ('BINOM.DIST',(6,10,.5,False),0.205078125),
    lambda: ('POISSON.DIST',(2,5,True),0.124652019),
    lambda: ('GAMMA.INV',(0.068094,9,2),10.0000112),
    lambda: ('BETA.DIST',(2,8,10,True,1,3),0.685470581),
    lambda: ('HYPGEOM.DIST',(1,4,8,20,True),0.465428277),
    lambda: ('NEGBINOM.DIST',(10,5,.25,False),0.055048660),
    lambda: ('WEIBULL.DIST',(105,20,100,True),0.929581390),
    lambda: ('CONFIDENCE.T',(0.05,1,50),0.284196855),
    lambda: ('BINOM.INV',(6,.5,.75),4.0),
    lambda: ('PMT',(.08/12,10,10000),-1037.0320893),
    lambda: ('IPMT',(.1/12,1,36,8000),-66.6666667),
    lambda: ('FV',(.06/12,10,-200,-500,1),2581.4033740),
    lambda: ('NPER',(.01,-100,-1000,10000,1),59.6738657),
    lambda: ('RATE',(48,-200,8000),0.0077014725),
    lambda: ('DDB',(2400,300,10,2,1.5),306.0),
    lambda: ('DB',(1e6,1e5,6,1,7),186083.3333),
    lambda: ('VDB',(2400,300,10,0,1),480.0),
    lambda: ('SYD',(30000,7500,10,1),4090.909090),
    lambda: ('EFFECT',(.0525,4),0.0535427),
    lambda: ('DOLLARDE',(1.02,16),1.125),
    lambda: ('CUMIPMT',(.09/12,360,125000,13,24,0),-11135.23213),
    lambda: ('IF',(True,1,2),1.0),
    lambda: ('IFERROR',(call('SQRT',-1),'bad'),'bad'),
    lambda: ('SWITCH',(2,1,'a',2,'b','c'),'b'),
    lambda: ('CHOOSE',(3,'a','b'),'#VALUE!'),
    lambda: ('ISERROR',(call('NA'),),'TRUE'),
    lambda: ('ERROR.TYPE',(call('NA'),),7.0),
    lambda: ('TYPE',('x',),2.0),
    lambda: ('XOR',(True,True),'FALSE'),
    lambda: ('nope',(),'#NAME?'),
    lambda: ('PI',(1,),'#VALUE!'),
]


def test_vectors(spark):
    made = [v() for v in VECTORS]
    vals = [call(name, *args) for name, args, _ in made]
    for start in range(0, len(vals), 30):
        part = range(start, min(start + 30, len(vals)))
        row = spark.range(1).select(*(vals[i].shown(f"s{i}") for i in part), *(vals[i].named(f"n{i}") for i in part if vals[i].kind == "number")).first()
        for i in part:
            name, _, want = made[i]
            if isinstance(want, float):
                assert row[f"n{i}"] == pytest.approx(want, rel=1e-6, abs=1e-9), name
            else:
                assert row[f"s{i}"] == want, name


def test_catalogue_size():
    assert len(FUNCTIONS) >= 275


def test_working_days(spark):
    row = spark.range(1).select(
        dates.networkdays(45292, 45322, [45292.0]).named("a"), dates.networkdays(45322, 45292).named("b"), dates.workday(45292, 10).named("c"), dates.workday(45292, -5, [45289.0]).named("d"), dates.networkdays(45292, 45322, [], 99).error("e"), dates.today().error("f")
    ).first()
    assert tuple(row) == (22.0, -23.0, 45306.0, 45282.0, "#VALUE!", "#N/A")


def test_errors_travel(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,), (-4.0,)], "x double")
    x = number("x")
    rows = df.select((10 / x).shown("a"), call("IFERROR", call("SQRT", x), -1).named("b"), (x + "1").named("c"), call("ISBLANK", x).named("d"), (x & "!").named("e")).collect()
    assert [tuple(r) for r in rows] == [("10", 1.0, 2.0, False, "1!"), ("#DIV/0!", 0.0, 1.0, False, "0!"), ("#DIV/0!", 0.0, 1.0, True, "!"), ("-2.5", -1.0, -3.0, False, "-4!")]


def test_inverses(spark):
    df = spark.range(1, 20).select((F.col("id") / 20).alias("p"))
    p = number("p")
    pairs = [("NORM.S.INV", (), lambda z: call("NORM.S.DIST", z, True)), ("T.INV", (7,), lambda z: call("T.DIST", z, 7, True)), ("CHISQ.INV", (4,), lambda z: call("CHISQ.DIST", z, 4, True)), ("F.INV", (3, 8), lambda z: call("F.DIST", z, 3, 8, True)), ("GAMMA.INV", (2.5, 1.5), lambda z: call("GAMMA.DIST", z, 2.5, 1.5, True)), ("BETA.INV", (2, 5), lambda z: call("BETA.DIST", z, 2, 5, True))]
    for name, args, back in pairs:
        df2 = df.withColumn("z", call(name, p, *args).named("z"))
        worst = df2.select(F.max(F.abs(back(number("z")).col - F.col("p")))).first()[0]
        assert worst < 1e-9, name
