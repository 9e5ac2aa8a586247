"""Small files of every input format, written by the tests themselves."""

import json
import sqlite3
import struct
from datetime import datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

NY = ZoneInfo("America/New_York")
BASE = datetime(2026, 7, 14, 18, 0, 0, tzinfo=NY)
AP, ATTACKER = "aa:bb:cc:00:00:01", "de:ad:be:ef:00:01"
CLIENT = "3c:22:fb:00:00:01"
ALL = "ff:ff:ff:ff:ff:ff"


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def us(seconds):
    return int(at(seconds).timestamp()) * 1_000_000


def mac_bytes(mac):
    return bytes.fromhex(mac.replace(":", ""))


def mgmt(src=ATTACKER, dst=ALL, bssid=AP, reason=7, subtype=12, protected=False):
    control = subtype << 4 | (0x4000 if protected else 0)
    return (
        struct.pack("<HH", control, 0) + mac_bytes(dst) + mac_bytes(src) + mac_bytes(bssid)
        + struct.pack("<HH", 0, reason)
    )


def radiotap(signal=-42, freq=2437):
    present = 1 << 1 | 1 << 2 | 1 << 3 | 1 << 5
    fields = struct.pack("<BBHHb", 0, 2, freq, 0, signal)
    return struct.pack("<BBHI", 0, 0, 8 + len(fields), present) + fields


def radiotap_tsft(signal=-55):
    present = 1 << 0 | 1 << 1 | 1 << 4 | 1 << 5
    fields = struct.pack("<QBBBb", 1, 0, 0, 0, signal)
    return struct.pack("<BBHI", 0, 0, 8 + len(fields), present) + fields


def pcap(packets, dlt=127, order="<", nanos=False, tail=b""):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, dlt)
    for ts_us, data in packets:
        fraction = ts_us % 1_000_000 * (1000 if nanos else 1)
        out += struct.pack(order + "IIII", ts_us // 1_000_000, fraction, len(data), len(data)) + data
    return out + tail


def pcapng(packets, dlt=127):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", dlt, 0, 65535) + struct.pack("<HHB3x", 9, 1, 6) + struct.pack("<HH", 0, 0))
    for ts, data in packets:
        out += block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


def rfc5424(seconds, proc, message):
    stamp = at(seconds).isoformat(timespec="milliseconds")
    return f'<134>1 {stamp} fw {proc} 123 - [meta sequenceId="1"] {message}'


def rfc3164(seconds, proc, message):
    return f"{at(seconds):%b %d %H:%M:%S} fw {proc}: {message}"


def write_all(folder: Path) -> dict[str, Path]:
    folder.mkdir(parents=True, exist_ok=True)
    files = {}

    def put(name, content):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        files[name] = path

    put(
        "logs/dnsmasq.log",
        "\n".join(
            rfc5424(s, "dnsmasq-dhcp", f"DHCP{op}(igb1) 192.168.1.50 {CLIENT}")
            for s, op in ((0, "ACK"), (60, "DISCOVER"), (61, "OFFER"), (62, "REQUEST"), (63, "ACK"))
        )
        + "\n\nnot a log line\n",
    )
    put(
        "logs/isc-dhcpd.log",
        "\n".join(rfc3164(s, "dhcpd", f"DHCP{op} from {CLIENT} via igb1") for s, op in ((5, "DISCOVER"), (6, "ACK"))),
    )
    put(
        "logs/hostapd.log",
        "\n".join(
            [
                rfc3164(30, "hostapd", f"wlan0: STA {CLIENT} IEEE 802.11: disassociated"),
                rfc3164(33, "hostapd", f"wlan0: STA {CLIENT} IEEE 802.11: associated (aid 1)"),
                rfc3164(40, "hostapd", f"wlan0: AP-STA-DISCONNECTED {CLIENT} reason=3"),
            ]
        ),
    )
    kea = at(12).strftime("%Y-%m-%d %H:%M:%S.") + "250"
    put(
        "logs/kea-dhcp4.log",
        f"{kea} INFO  [kea-dhcp4.leases/7] DHCP4_LEASE_ALLOC [hwtype=1 {CLIENT.upper()}], cid=[x], tid=0x1: lease 10.0.0.5\n"
        f"{kea} INFO  [kea-dhcp4.leases/7] DHCP4_LEASE_RENEW [hwtype=1 {CLIENT}], tid=0x1\n"
        f"{kea} INFO  [kea-dhcp4.packets/7] DHCP4_PACKET_RECEIVED [hwtype=1 {CLIENT}], packet type DHCPDISCOVER\n"
        f"{kea} INFO  [kea-dhcp4.leases/7] DHCP4_RELEASE [hwtype=1 {CLIENT}]\n",
    )
    put(
        "logs/fetched.json",
        json.dumps(
            {
                "saved_fetch": 1,
                "firewall": {"host": "fw", "tls": "UNVERIFIED"},
                "request": {"label": "dhcp"},
                "complete": False,
                "rows": [
                    {"timestamp": at(0).isoformat(), "process_name": "dnsmasq-dhcp", "line": f"DHCPACK(igb1) 192.168.1.50 {CLIENT}"},
                    {"timestamp": at(60).isoformat(), "line": f"dnsmasq-dhcp[12]: DHCPDISCOVER(igb1) {CLIENT}"},
                    {"timestamp": "when?", "line": "x"},
                    {"time": str(us(70) // 1_000_000), "msg": f"hostapd: STA {CLIENT} IEEE 802.11: disassociated"},
                ],
            }
        ),
    )
    stamp = "%Y-%m-%dT%H:%M:%S%z"
    put(
        "camera/camera_events.csv",
        "timestamp,plate,make,model,notes\n"
        f"{at(100):{stamp}},ABC123,Ford,F150,\"blue, dented\"\n"
        f"{at(200):{stamp}},,,,\n"
        "soon,X,,,\n",
    )
    put("camera/bare.tsv", f"{at(300):%Y-%m-%d %H:%M:%S}\tXYZ\tVW\tGolf\tseen\n{at(310):%m/%d/%Y %I:%M:%S %p}\tXYZ2\n")
    names = [
        f"{at(0):%Y%m%d_%H%M%S}.mp4", f"Reolink_{at(1):%Y%m%d_%H%M%S}.mp4", f"ip_01_{at(2):%Y%m%d%H%M%S}000.mp4",
        f"NVR_ch1_main_{at(3):%Y%m%d%H%M%S}.dav", f"{at(4):%Y-%m-%d_%H.%M.%S}_cam1.mp4", f"{at(5):%Y-%m-%dT%H-%M-%S}.mkv",
    ]
    for name in names:
        put(f"clips/{name}", b"x")
    frames = [(us(400) + i * 90_000, radiotap() + mgmt(reason=7, subtype=10 if i % 7 == 6 else 12)) for i in range(8)]
    beacon = (us(399), radiotap() + mgmt(subtype=8))
    put("captures/capture-01.cap", pcap([beacon, *frames]))
    put("captures/big-endian.pcap", pcap([(us(410), mgmt(dst=CLIENT, reason=1))], dlt=105, order=">", nanos=True))
    put("captures/cut.pcap", pcap([(us(411), mgmt(protected=True))], dlt=105, tail=b"\1\2\3\4" * 4 + b"x"))
    put("captures/capture.pcapng", pcapng([(us(420) + i, radiotap_tsft() + mgmt()) for i in range(6)]))
    put("captures/wired.pcap", pcap([(us(1), b"\0" * 60)], dlt=1))
    db = folder / "captures/kismet.kismet"
    con = sqlite3.connect(db)
    con.executescript(
        "CREATE TABLE KISMET (v INT); CREATE TABLE devices (d TEXT);"
        "CREATE TABLE packets (ts_sec INT, ts_usec INT, signal INT, dlt INT, packet BLOB);"
        "CREATE TABLE alerts (ts_sec INT, ts_usec INT, devmac TEXT, header TEXT, json TEXT);"
    )
    con.executemany(
        "INSERT INTO packets VALUES (?, ?, ?, ?, ?)",
        [(us(430) // 1_000_000, 5, -60, 127, radiotap() + mgmt()), (us(430) // 1_000_000, 9, 0, 127, radiotap() + mgmt(dst=CLIENT)), (1, 1, 0, 1, b"wired")],
    )
    con.executemany(
        "INSERT INTO alerts VALUES (?, ?, ?, ?, ?)",
        [
            (us(431) // 1_000_000, 0, AP, "DEAUTHFLOOD", json.dumps({"kismet.alert.text": "flood!", "kismet.alert.source_mac": ATTACKER})),
            (us(432) // 1_000_000, 0, AP, "BCASTDISCON", json.dumps({"kismet.alert.source_mac": "00:00:00:00:00:00"})),
            (us(433) // 1_000_000, 0, AP, "OTHER", "{}"),
        ],
    )
    con.commit()
    con.close()
    files["captures/kismet.kismet"] = db
    local = "%Y-%m-%d %H:%M:%S"
    put(
        "captures/airodump-01.csv",
        "\r\nBSSID, First time seen, Last time seen, channel, Speed, Privacy, Cipher, Authentication, Power, # beacons, # IV, LAN IP, ID-length, ESSID, Key\r\n"
        f"{AP.upper()}, {at(0):{local}}, {at(9):{local}}, 6, 130, WPA2, CCMP, PSK, -40, 10, 0, 0.0.0.0, 4, home, \r\n\r\n"
        "Station MAC, First time seen, Last time seen, Power, # packets, BSSID, Probed ESSIDs\r\n"
        f"{CLIENT.upper()}, {at(0):{local}}, {at(440):{local}}, -50, 12, {AP.upper()}, home\r\n"
        f"3C:22:FB:00:00:02, {at(0):{local}}, {at(441):{local}}, -51, 3, (not associated) , \r\n",
    )
    put(
        "captures/nzyme-deauth.csv",
        "timestamp,subtype,transmitter,destination,bssid,reason_code,channel,signal_strength,ssid\n"
        f"{at(450).isoformat()},deauth,{ATTACKER},{ALL},{AP},7,6,-45,home\n"
        f"{at(451).isoformat()},0x000a,{ATTACKER},{CLIENT},{AP},0x08,6,-45,home\n"
        f"{at(452).isoformat()},beacon,{ATTACKER},{CLIENT},{AP},,6,-45,home\n"
        f"bad,deauth,{ATTACKER},{CLIENT},{AP},1,6,-45,home\n",
    )
    return files
